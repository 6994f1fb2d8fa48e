"""Problem 2: broken prompt and response pairs.

Openings of the answers are clustered by verified MinHash. A class that recurs across
unrelated prompts in one wording, without slots, is a template; one that says that the
speaker can't or won't, or that is all that unlike questions got for an answer, is a
refusal. Copy, termination and language checks label the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblion.llm import minhash
from biblion.llm.lang import CharTable, LanguageModel, train
from biblion.session import checkpoint

# Wording of inability in the first person or without person, by language.
INABILITY = [
    r"\b(?:sorry|apolog(?:y|ies|i[sz]e)|regret|guidelines|polic(?:y|ies)|decline|refuse|permitted|allowed|unable|not able|cannot|can't|can not|won't|will not|rather not|prevents? me|no answer)\b",
    r"\b(?:not|don't|do not) feel comfortable\b", r"\bas an? (?:ai|language) model\b", r"\bnot something i\b",
    r"\bje (?:suis désolée?|ne peux|ne suis pas|regrette|refuse)\b", r"\bne (?:peux|suis) pas (?:vous aider|en mesure|autorisé|répondre)", r"\bdésolée?\b", r"\bil m'est impossible\b",
    r"\b(?:es )?tut mir leid\b", r"\bkann ich (?:leider )?nicht\b", r"\bich (?:kann|darf|möchte)\b.*\bnicht\b", r"\bleider (?:nicht|kann|darf)\b", r"\bmir nicht (?:möglich|erlaubt|gestattet)\b", r"\bdarf ich nicht\b",
    r"\blo siento\b", r"\bno (?:puedo|me es posible|me está permitido|estoy autorizad|podré)\b", r"\blamento\b",
    r"죄송", r"(?:수|할 수) 없습니다", r"허용되지 않", r"어렵습니다", r"도와드릴 수 없", r"답변할 수 없", r"거절", r"\bnão posso\b", r"\bnon posso\b", r"\bmi dispiace\b", r"\bdesculpe\b", r"できません", r"無法|无法|抱歉",
]
REFUSED_ERROR = r"polic|content[_ ]filter|moderation|safety|declin|refus|blocked"
CUT_ERROR = r"max_?tokens|finish_reason ?[=:] ?length|(?:output|length|token) limit|truncat|closed before|cut off|incomplete"
# Answers that say nothing.
NOTHING = frozenset([
    "n/a", "na", "null", "none", "nil", "nan", "undefined", "empty", "answer", "response", "output", "result", "{}", "[]", "()", "-", "–", "—",
    "...", "…", ".", "", "json", "no answer", "no response", "no output", "not available", "unknown",
])
# Names of the languages in the languages prompts are written in.
LANGUAGE_NAMES = {
    "en": ["english", "inglés", "anglais", "englisch", "영어"],
    "de": ["german", "alemán", "allemand", "deutsch", "독일어"],
    "fr": ["french", "francés", "français", "französisch", "프랑스어"],
    "es": ["spanish", "español", "espagnol", "spanisch", "스페인어"],
    "ko": ["korean", "coreano", "coréen", "koreanisch", "한국어"],
}
# Words no sentence ends with.
OPEN_WORDS = frozenset(
    "the a an of and or to in on at by for with from that which who whose is are was were be been as than not but if when whether into only "
    "der die das den dem des ein eine und oder zu im in mit von für auf dass le la les un une des du de et ou à dans pour avec que qui el los las una y o en con por para que del al".split()
)

#: Sentences an answer has on average, at most, and words its opening has, at least, for a template to decline whatever its
#: wording: what is given as the whole answer to unlike questions answers none of them.
WHOLE, LEAST_WORDS = 1.1, 3

_NAMES = "|".join(n for names in LANGUAGE_NAMES.values() for n in names)
_ASK = regex.compile(rf"(?i)(?:\b(?:in|en|auf|into|to)\s+|:\s*)(?P<name>{_NAMES})\b|(?P<name>{_NAMES})로")
_NAMED = {name: code for code, names in LANGUAGE_NAMES.items() for name in names}
_TASK = regex.compile(r"(?:^|\n)(?:Task|Question|Instruction)s?:(?=.)", regex.S)
_BLOCK = regex.compile(r"### Instruction\s*\n(.+?)(?:\n### |\Z)", regex.S)
_FENCE = regex.compile(r"^```\w*\s*|\s*```$")
_LABEL = regex.compile(r"(?i)^(?:answer|response|output|result|summary|question|prompt|q|a|task|instruction|frage|aufgabe|pregunta|tarea|tâche|질문|you asked)s?\s*:\s*")
_HAS_TEXT = regex.compile(r"[\p{L}\p{N}]")
_FENCE_START, _CITED = regex.compile(r"^```\w*\s*"), regex.compile(r"\[\d+\]|\[[A-Z]")
_NOTE = regex.compile(r"(?:note|hinweis|remarque|nota|참고)\s*:\s*")
_PARTS, _LINES = regex.compile(r"(?<=[.?!])\s+"), regex.compile(r"(?<=[.?!])\s+|\n+")
_TAG = regex.compile(r"</?\w+>")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Zs}\s]+")
# What isn't kept becomes a blank.
_PLAIN, _OPENING = CharTable(r"[\p{L}\p{N}]"), CharTable(r"[\p{L}' ]")
_SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+|\n+")
_CUES = regex.compile("|".join(INABILITY))
_REFUSED, _CUT = regex.compile(REFUSED_ERROR, regex.I), regex.compile(CUT_ERROR, regex.I)
_LINE_EDGES = regex.compile(r"(?m)^[>\s\"'`*-]+|[\"'`*\s]+$")
_ENDED = regex.compile(r"[.!?。！？][\"'”’»)\]*_`]*$|[:;]?[)\]}\"”»]$")
_REFERENCE_END = regex.compile(r"(?i)(?:^|[.!?\]] )(?:see|see also|siehe|vgl|voir|véase)\b[^.]*(?:\w+\. )?#?\d+$|(?:^|\n)[\p{L} ]{2,30}: ?[\p{L}\p{N}.,%]+$")
_BROKEN = regex.compile(r"(?:…|\.\.\.|[\[(<]\s*(?:truncated|cut|continued|…|\.\.\.)\s*[\])>]?|<\|?|<\|[^|]*\|?>?|[,;(\[{/–-])$", regex.I)
# What a broken end ends with, "<|" and what follows it aside.
_BROKEN_ENDS = ("…", "...", *"dDtT[](){}<>|/,;–-")


def question(prompt: str) -> str:
    """What a prompt asks: its task line or instruction block, else its first paragraph."""
    if m := _TASK.search(prompt):
        return prompt[m.end() :].strip()
    if "### Instruction" in prompt and (m := _BLOCK.search(prompt)):
        return m[1].strip()
    return prompt.strip().split("\n\n")[0].strip()


def plain(text: str) -> str:
    return " ".join(text.lower().translate(_PLAIN).split())


def blanks(text: str) -> str:
    """Runs of blanks and invisible signs as one blank, none at the ends."""
    if text.replace("\n", " ").isprintable():
        return " ".join(text.split())  # nothing but blanks and line ends to replace
    return _INVISIBLE.sub(" ", text).strip()


def bare(text: str) -> str:
    """An answer without fences, tags, labels, quotes and blanks around it."""
    out = blanks(_TAG.sub(" ", text) if "<" in text else text)
    while True:
        less = _LABEL.sub("", _FENCE.sub("", out) if "`" in out else out).strip()
        if less == out:
            return out
        out = less


def bare_lines(text: str) -> str:
    out = _FENCE.sub("", text.strip()) if "`" in text else text.strip()
    if out.isprintable():
        return out.lstrip(" >\"'`*-").rstrip(" \"'`*")  # one line
    return _LINE_EDGES.sub("", out)


def openings(sentences: list[str]) -> list[str]:
    """The first two sentences in normal form: lower case, digits and a label before them left out."""
    out = []
    for sentence in sentences[:3]:
        sentence = sentence.lower().replace("’", "'")
        if m := _NOTE.match(sentence):
            sentence = sentence[m.end() :]
        quoted = sentence[:1] in "\"“«'„"
        words = sentence.translate(_OPENING).split()
        if words:
            out.append(("« " if quoted else "") + " ".join(words))
        if len(out) == 2:
            break
    return out


def parse_json(text: str) -> bool | None:
    """Whether a JSON answer is whole; None if it isn't JSON."""
    body = _FENCE_START.sub("", text.strip())
    if body[:1] not in ("{", "[") or _CITED.match(body):
        return None
    try:
        json.JSONDecoder().raw_decode(body)
        return True
    except ValueError:
        return False


def broken_off(answer: str) -> bool:
    text = answer.strip()
    whole = parse_json(text)
    if whole is not None:
        return not whole
    tail = text[-120:]  # all of these are anchored at the end
    if (tail.endswith(_BROKEN_ENDS) or "<|" in tail) and _BROKEN.search(tail):
        return True
    if _ENDED.search(tail) or _REFERENCE_END.search(tail):
        return False
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    last = lines[-1].split()
    if len(lines) == 1 and len(last) <= 2 and len(text) <= 20:
        return False  # a label
    ends_open = last[-1].lower().strip(",;:") in OPEN_WORDS
    listed = len(lines) > 1 and sum(not _ENDED.search(x) or x.endswith("?") for x in lines[:-1]) * 2 > len(lines) - 1
    return ends_open or not listed


class Question:
    """What the checks need of a question, each worked out when first asked for."""

    def __init__(self, asked: str, model: LanguageModel):
        self.asked, self.model = asked, model

    @cached_property
    def wordings(self) -> tuple[str, str]:
        return plain(self.asked), plain(_ASK.sub("", self.asked))

    @cached_property
    def parts(self) -> set[str]:
        return {plain(x) for x in _PARTS.split(self.asked)} | {plain(self.asked)}

    @cached_property
    def wanted(self) -> str | None:
        """The language of the answer: the last one named, else the question's own."""
        names = [_NAMED.get(m["name"].lower()) for m in _ASK.finditer(self.asked)]
        return next((x for x in reversed(names) if x), None) or self.model.guess(self.asked)


def check(prompt: str | None, answer: str | None, error: str | None, model: LanguageModel, core: str | None = None, asks: Question | None = None) -> str | None:
    """The defect of a pair by itself, refusals with text aside."""
    text, ask, said = answer or "", prompt or "", error or ""
    core = bare(text) if core is None else core
    if not core or core.lower().strip(" \"'`*") in NOTHING or not _HAS_TEXT.search(core):
        return "refusal" if _REFUSED.search(said) else "empty"
    asks = asks or Question(question(ask), model)
    asked = asks.asked
    if len(core) <= 3 * len(asked) + 40 or 0.7 * len(ask) <= len(core) <= 1.3 * len(ask) + 40:
        mine = plain(core)
        if len(mine) >= 8:
            if mine in asks.wordings:
                return "copy"
            # Only an answer of the prompt's length can be the prompt.
            whole = plain(bare(ask)) if 0.7 * len(ask) <= len(core) else ""
            if whole and len(mine) >= 0.9 * len(whole) and whole.startswith(mine):
                return "copy"
        longest = 0
        for x in _LINES.splititer(bare_lines(text)):
            part = plain(_LABEL.sub("", x.strip()))
            if part and part not in asks.parts:
                break  # one part of its own is enough
            longest = max(longest, len(part))
        else:
            if longest >= 8:
                return "copy"
    if _CUT.search(said) or broken_off(text):
        return "truncated"
    if parse_json(text) is None:
        is_ = model.guess(core)
        if asks.wanted and is_ and asks.wanted != is_:
            return "wrong_language"
    return None


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def defective_pairs(traces: DataFrame, labelled: DataFrame, min_prompts: int = 3, one_wording: float = 0.5, longest: int = 5) -> DataFrame:
    """Defective pairs: ``trace_id`` and ``defect_type``, one row each.

    ``labelled`` (doc_id, text, lang) trains the language check. A class of openings is
    a template if at least ``min_prompts`` different prompts got it and of the openings that share its first four words one
    wording makes up ``one_wording`` or more (a template with slots, filled in many ways,
    carries content). A template declines if its wording tells inability or if it makes
    up whole answers (``WHOLE``). A refusal has at most ``longest`` sentences. Ids that repeat
    count once, by the greatest pair; rows with NULL ids are left out. NULL prompts ask
    nothing, so only their answers are checked.
    """
    model = train(labelled)
    shared = traces.sparkSession.sparkContext.broadcast((model.langs, model.weights))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LanguageModel.of(shared.value)

        def ask(asked: str) -> tuple[Question, int]:
            return Question(asked, known), _hash(asked)

        met = lru_cache(5_000)(ask)  # a question recurs over many articles; long ones aren't kept
        for batch in batches:
            rows = []
            for id_, prompt, answer, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                core = bare(answer or "")
                wording = question(prompt or "")
                asks, asked = met(wording) if len(wording) <= 500 else ask(wording)
                defect = check(prompt, answer, error, known, core, asks)
                sentences = [x for x in _SENTENCE.split(core) if x.strip()]
                if parse_json(core) is not None and not _CUES.search(core.lower()):
                    sentences = []  # fields of an answer are no opening
                rows.append((id_, defect, openings(sentences), len(sentences), asked))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64())],
                names=["trace_id", "defect", "openings", "n_sentences", "asked"],
            )

    rows = (
        traces.where("id is not null")
        .select(F.col("id").cast("long").alias("id"), "input_text", "output_text", "error_message")
        .mapInArrow(features, "trace_id long, defect string, openings array<string>, n_sentences int, asked long")
        .groupBy("trace_id")
        .agg(F.max(F.struct("defect", "openings", "n_sentences", "asked")).alias("v"))
        .select("trace_id", "v.*")
    )
    rows = checkpoint(rows)
    opened = rows.select("trace_id", "n_sentences", "asked", F.coalesce(F.col("defect") == "truncated", F.lit(False)).cast("int").alias("cut"), F.explode("openings").alias("text")).where(~F.col("text").startswith("«"))
    # Summed by text before anything else; an answer's prompts and sentences go with its opening.
    stats = opened.groupBy("text", "asked").agg(F.count(F.lit(1)).alias("n"), F.sum("n_sentences").alias("s"), F.sum("cut").alias("cut")).groupBy("text").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("prompts"), (F.sum("s") / F.sum("n")).alias("sentences"), (F.sum("cut") / F.sum("n")).alias("cut")
    )
    said = checkpoint(stats)
    # What was said once counts as well: its prompt is one of its class's, and it can tie others.
    rep = checkpoint(minhash.classes(said.select("text")))
    head = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    family = said.groupBy(head.alias("head")).agg(F.max("n").alias("most"), F.sum("n").alias("records"))
    unslotted = family.where(F.col("most") >= F.lit(one_wording) * F.col("records")).select("head")
    classed = rep.join(said, "text").withColumn("head", head)
    # Prompts of a class: each counts once, whatever the wording it got.
    of_class = opened.join(rep, "text").select("rep", "asked").distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("of_class"))
    templates = checkpoint(classed.join(unslotted, "head", "left_semi").join(of_class.where(F.col("of_class") >= min_prompts).select("rep"), "rep", "left_semi").select("text", "sentences", "prompts", "cut"))
    whole = (F.col("sentences") <= WHOLE) & (F.col("cut") < 0.5) & (F.col("prompts") >= min_prompts) & (F.size(F.split("text", " ")) >= LEAST_WORDS)
    told = F.col("text").rlike("|".join(INABILITY))
    refusals = templates.where(told | whole).select("text")
    refused = (
        opened.where(F.col("n_sentences") <= longest).join(refusals, "text", "left_semi").select("trace_id").distinct().withColumn("refused", F.lit(True))
    )
    kind = F.when(F.col("refused"), "refusal").otherwise(F.col("defect"))
    return (
        rows.select("trace_id", "defect").join(refused, "trace_id", "left").select("trace_id", kind.alias("defect_type")).where("defect_type is not null")
    )
