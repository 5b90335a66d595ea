"""What is wrong with one answer, seen alone or beside its original or question: plain functions for Python workers."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

from corpusloom.llm.languages import Languages, language_of
from corpusloom.llm.words import INVISIBLE, TAG, common_in_order, plain, words

#: Whole answers that stand for no answer (lower case, words only).
PLACEHOLDERS = frozenset(
    "na|n a|null|none|nil|nan|undefined|void|empty|blank|tbd|todo|placeholder|no output|no response|no answer|no text|no content|no result|no rewrite|empty response|empty output|empty answer|"
    "response|output|answer|rewritten text|rewritten version|rewrite|paraphrase|paraphrased text|text|abstract|rewritten abstract|essay|rewritten essay|result|your text here|insert text here|lorem ipsum|"
    "keine antwort|kein text|leer|pas de réponse|sin respuesta|inget svar|tomt svar|error|none provided|not available|not applicable|no data|missing|unknown".split("|")
)
#: Sentences that only announce an answer.
ANNOUNCED = re.compile(
    r"^(?:(?:sure|certainly|of course|absolutely|okay|ok|yes|here you go|gladly)\b[\s,.!:-]*)*(?:here(?:'s| is| are)\b[^.!?:\n]{0,80}|(?:the |my |your )?(?:rewritten|paraphrased|revised|reworded)\b[^.!?:\n]{0,60})[\s.:!*_#-]*$", re.I
)
#: How an answer declines. DECLINES alone, REFUSES together with a word about the task.
DECLINES = re.compile(
    r"\bcontent filter\b|\brequest (?:was |is |has been )?(?:declined|denied|refused|blocked)|\b(?:must|have to|need to|will|shall|do|i'll|ll) (?:respectfully |politely )?(?:decline|refuse|refrain|abstain)\b|\bdeclin(?:e|ing) (?:to|the|this|your|that)\b|\brefuse to\b"
    r"|\b(?:no|not a) (?:paraphrase|rewrite|rewritten version|version|answer|text|response) (?:will|can|could) be (?:given|provided|produced|written|made)|\boutside (?:of )?what i\b|\bbeyond what i\b|\bnot something (?:that )?i(?:'m| am)? (?:can|could|will|may|able|allowed|do|produce)"
    r"|\binstructed not to\b|\b(?:against|violates?|violating|contrary to|conflicts? with|breach(?:es)?(?: of)?) (?:my|our|the|its) (?:\w+ )?(?:guidelines?|polic(?:y|ies)|rules?|principles?|terms|instructions?|programming)|\bnot (?:be )?(?:appropriate|possible|permitted|allowed) for me\b"
    r"|\b(?:policy|policies|rules|guidelines) (?:do|does|will|would) ?(?:not|n't) (?:permit|allow|let)|\b(?:withheld|blocked|suppressed|removed) (?:by|for|because|due)\b|\bas an ai\b|\bnot comfortable\b|\bfeel (?:un|not )comfortable\b|\b(?:would|'d) (?:rather|prefer) not\b|\bprefer not to\b"
    r"|\bi(?:'m| am) (?:afraid|sorry)[^.!?]{0,20} (?:no|that is not possible|i can|i won|i am|i must)\b|\bnot (?:do|does) reproduce\b|\bleave it at that\b|\b(?:have to|must|will|shall|going to) pass on (?:this|that|the|your)\b", re.I
)
REFUSES = re.compile(
    r"\b(?:i|we)(?:'m| am|'re| are|'d| would| will|'ll)? ?(?:also |really |just |simply |unfortunately |sadly |afraid i )?(?:can ?not|can't|cant|could not|couldn't|won't|will not|wouldn't|would not|unable to|not able to|not allowed to|not permitted to|not going to|not in a position to|not authori[sz]ed to|do not|don't|may not|not at liberty to)\b[^.!?]{0,60}?"
    r"\b(?:help|assist|rewrit\w*|reword\w*|paraphras\w*|rephras\w*|produc\w*|answer\w*|continue|fulfil\w*|comply|request|version|this one|do (?:that|this|so)|take part|engage|feel comfortable|provide|process|respond|reproduce|complete|work (?:on|with)|carry|handle|touch|edit|generate|write|offer|support|discuss|able)\b"
    r"|\b(?:unable to|not able to|not allowed to|not permitted to) (?:help|assist|provide|rewrite|reword|paraphrase|rephrase|answer|complete|fulfil\w*|comply|continue|produce|process|respond)\b", re.I
)
#: The same in the other languages of the corpus, for answers of few words.
REFUSES_ABROAD = re.compile(
    r"\b(?:ich kann|kann ich|darf ich|ich darf|ich möchte)\b[^.!?]{0,60}\bnicht\b|\bnicht (?:helfen|umschreiben|umformulieren|bearbeiten|beantworten)\b|\bje ne (?:peux|puis|suis|veux|souhaite)\b[^.!?]{0,40}\b(?:pas|refus\w*)?|\bno (?:puedo|podemos|me es posible|estoy autorizad\w)\b|\bjag (?:kan|får|vill)\b[^.!?]{0,30}\binte\b|\b(?:hjälpa|skriva om)\b[^.!?]{0,30}\binte\b",
    re.I,
)
#: Who declines, words that decline, and words for the task; a short answer with all three in a sentence declines.
SPEAKER = re.compile(r"\b(?:i|we|my|our|me|us|this (?:assistant|system|model))\b", re.I)
SAYS_NO = re.compile(r"\b(?:no|not|never|cannot|unable|unwilling|declin\w*|refus\w*|refrain\w*|abstain\w*|prevent\w*|prohibit\w*|forbid\w*|restrict\w*|disallow\w*|against|violat\w*|impossible|inappropriate|withhold\w*|avoid\w*|stops?|bars?|pass on)\b|n't\b", re.I)
TASK = re.compile(r"\b(?:rewrit\w*|reword\w*|rephras\w*|paraphras\w*|request\w*|assist\w*|fulfil\w*|comply\w*|this (?:essay|passage|text|abstract|question|prompt|task|content|topic|instruction))\b", re.I)
SHORT, SHORT_ABROAD = 70, 40
_HINT = re.compile(r"n't\b|\b(?:not|cannot|unable|declin|refus|prefer|afraid|comfortable|policy|policies|guidelines|filter)", re.I)
_SENTENCE = re.compile(r"[.!?\n]+")
_APOSTROPHES = str.maketrans("’‘`´ʼ", "'''''")
_WORD = re.compile(r"\w+")


def is_empty(text: str | None) -> bool:
    """No answer at all: null, blank, invisible, or nothing but a placeholder, mark-up or the announcement of an answer."""
    if not text:
        return True
    if len(text) > 300 and "<" not in text and "&" not in text and text.isascii() and len(text.split(None, 60)) > 60:
        return not _WORD.search(text)
    core = plain(text).strip()
    if len(core) > 300:
        return not _WORD.search(core)
    ws = _WORD.findall(core.lower().replace("_", " "))
    if not ws or " ".join(ws) in PLACEHOLDERS:
        return True
    return len(ws) <= 20 and ("\n" not in core) and bool(ANNOUNCED.match(core.translate(_APOSTROPHES).strip(" \t\n\r*_#>`\"")))


def is_refusal(text: str | None, original: str | None = None, prompt: str | None = None) -> bool:
    """The answer declines the task and does not do it.

    Few words, among them a way to decline; or, beside an original or a prompt, few words of which a sentence names who
    declines, that they do, and the task; or an answer of any length that begins by declining and has hardly a word of
    its original.
    """
    if not text:
        return False
    if text.count(" ") > SHORT + 30:
        head = text[:400].translate(_APOSTROPHES)
        if not original or not _HINT.search(head):
            return False
        first = " ".join(_SENTENCE.split(INVISIBLE.sub("", TAG.sub(" ", head)).strip())[:2])
        return bool(REFUSES.search(first) or DECLINES.search(first)) and _shared(text, original) < 0.15
    core = INVISIBLE.sub("", unicodedata.normalize("NFC", TAG.sub(" ", text))).translate(_APOSTROPHES)
    n = len(core.split())
    if n > SHORT:
        return bool(original) and bool(_HINT.search(core)) and bool(REFUSES.search(core[:300]) or DECLINES.search(core[:300])) and _shared(text, original) < 0.15
    if DECLINES.search(core) or REFUSES.search(core) or (n <= SHORT_ABROAD and REFUSES_ABROAD.search(core)):
        return True
    if not (original or prompt) or not any(SAYS_NO.search(s) and SPEAKER.search(s) and TASK.search(s) for s in _SENTENCE.split(core)):
        return False
    return _shared(text, original or prompt) < 0.35


def _shared(answer: str, given: str) -> float:
    """Share of the answer's longer words that stand in what was given."""
    own = {w for w in words(answer) if len(w) >= 5}
    return len(own.intersection(_words_of(given))) / max(1, len(own))


def gives_back(answer: list[bytes], given: list[bytes], also: list[bytes] = ()) -> bool:
    """answer holds nine tenths of the words of `given` in order, and little besides them and the words of `also`."""
    if not given or len(answer) < 0.9 * len(given):
        return False
    need = -(-9 * len(given) // 10)
    if len(set(given).difference(answer)) > len(given) - need:
        return False  # each of these words is without a partner
    if sum((Counter(answer) & Counter(given)).values()) < need:
        return False
    known = set(given) | set(also)
    rest = sum(w not in known for w in answer)
    if rest > max(12, len(answer) // 5) or (len(given) > 40 and len(answer) - len(given) > max(25, len(given) // 4) + len(also)):
        return False
    if len(given) <= 40 and rest > max(6, len(answer) // 5):
        return False
    return common_in_order(given, answer) >= need


@lru_cache(maxsize=2048)
def _words_of(text: str | None) -> tuple[bytes, ...]:
    """words() of prompts, and of originals that follow one another in a sorted batch."""
    return tuple(words(text))


def is_copy(text: str, original: str | None, prompt: str | None) -> bool:
    """It gives back the original text or the prompt, the same or almost, perhaps framed."""
    answer = words(text)
    return bool(answer) and _copies(answer, original, prompt)


def _copies(answer: list[bytes], original: str | None, prompt: str | None) -> bool:
    p = _words_of(prompt)
    if gives_back(answer, p):
        return True
    return bool(original) and gives_back(answer, _words_of(original), p)


def in_other_language(text: str, beside: str | None, languages: Languages | None) -> bool:
    """More than half of the words are in sentences of another language than `beside` is in; False where that isn't known."""
    if languages is None or not beside:
        return False
    own = language_of(languages, beside)
    return own >= 0 and languages.in_other(text, own)


def defect(text: str | None, original: str | None, prompt: str | None, beside: str | None, languages: Languages | None = None) -> str | None:
    """empty, refusal, copy, other_language or None; `beside` is what the answer should share its language with."""
    if is_empty(text):
        return "empty"
    answer = words(text)
    if _copies(answer, original, prompt):
        return "copy"
    if is_refusal(text, original, prompt):
        return "refusal"
    return "other_language" if in_other_language(text, beside, languages) else None
