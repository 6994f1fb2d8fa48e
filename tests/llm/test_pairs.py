import random

import regex

from biblion.llm import lang, minhash, pairs
from biblion.llm.lang import LanguageModel
from biblion.llm.minhash import classes, jaccard
from biblion.llm.pairs import broken_off, check, defective_pairs, question

EN = "The authors describe what the ward nurses think about the tool and why it matters for the patients in the clinic. "
DE = "Die Autorinnen beschreiben, was die Pflegekräfte über das Werkzeug denken und warum es für die Klinik wichtig ist. "
MODEL = LanguageModel({"en": [EN, EN], "de": [DE, DE]})


def test_single_checks():
    q = "Summarise what the article says about the tool and the patients."
    assert check(q, EN, None, MODEL) is None
    assert check(q, DE, None, MODEL) == "wrong_language" and check(q + " Answer in German.", DE, None, MODEL) is None
    assert check(q, "​", None, MODEL) == "empty" and check(q, None, "content_filter", MODEL) == "refusal" and check(q, "```json\n```", None, MODEL) == "empty"
    assert check("Do both names denote the same? Reply yes or no.", "No", None, MODEL) is None
    assert check(q, q.upper().rstrip("."), None, MODEL) == "copy" and check(f"Article:\n{EN}\n\nTask: {q}", f"Task: {q}", None, MODEL) == "copy"
    assert check(q, EN + "The nurses", None, MODEL) == "truncated" and check(q, EN, "finish_reason=length", MODEL) == "truncated"
    assert check(None, None, None, MODEL) == "empty" and check(None, EN, "cache miss", MODEL) is None


def test_ends():
    assert broken_off('{"a": [1, 2') and not broken_off('```json\n{"a": 1}\n```') and not broken_off("KEEP") and not broken_off("Key points:\n- One thing\n- Other thing")
    assert broken_off("A sentence. And then…") and not broken_off("A sentence. See also Fig. 2") and not broken_off("All is said. (End of summary)")
    assert question("### Instruction\nDo it.\n### Input\nText") == "Do it."


def test_refusals_by_recurrence(spark):
    no = "I cannot assist with this request."
    rows = [(i, f"Question number {w} about the ward?", no, None) for i, w in enumerate("one two three four five".split())]
    rows += [(20 + i, f"Which limits {w}?", f"I can't find a stated limit on {w} in this text; the closest is the remark on wards.", None) for i, w in enumerate("apples pears plums figs dates".split())]
    rows += [(40, "What of it?", EN, None), (0, "Question number one about the ward?", no, None), (None, "x", "", None), (41, None, None, None)]
    traces = spark.createDataFrame([(*r, "x") for r in rows], "id long, input_text string, output_text string, error_message string, defect string")
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (EN, "en"), (DE, "de"), (None, "en"), (EN, None)])], "doc_id long, text string, lang string")
    got = {r.trace_id: r.defect_type for r in defective_pairs(traces, docs).collect()}
    assert {i for i, k in got.items() if k == "refusal"} == {0, 1, 2, 3, 4} and got[41] == "empty" and 40 not in got and not any(20 <= i < 30 for i in got)
    assert defective_pairs(traces.limit(0), docs).count() == 0


def test_whole_answers_to_unlike_questions_decline(spark):
    """No listed wording: what unlike questions get as their whole answer is no answer; one question's own and parts of longer ones are none of these."""
    asks = [f"What about {w} in the ward?" for w in "apples pears plums figs dates".split()]
    rows = [(i, q, "Das muss ich ablehnen und sage nichts.", None) for i, q in enumerate(asks)]
    rows += [(10 + i, asks[0], "The authors see a need for more plums.", None) for i in range(5)]
    rows += [(20 + i, q, "The sample was small in size. " + EN, None) for i, q in enumerate(asks)]
    traces = spark.createDataFrame(rows, "id long, input_text string, output_text string, error_message string")
    docs = spark.createDataFrame([(1, EN, "en"), (2, DE, "de")], "doc_id long, text string, lang string")
    got = {r.trace_id for r in defective_pairs(traces, docs).where("defect_type = 'refusal'").collect()}
    assert got == set(range(5))


def test_openings_said_once_count_in_their_class(spark):
    """A refusal said once is a template through the near wordings that other prompts got once."""
    rest = "the ward nurses and the clinic managers of this hospital leave that question open for all of us today again."
    rows = [(i, f"What about {w} in the ward?", f"{first} {rest}", None) for i, (w, first) in enumerate(zip(["apples", "pears", "plums"], ["Sorry", "Well", "Here"], strict=True))]
    traces = spark.createDataFrame(rows, "id long, input_text string, output_text string, error_message string")
    docs = spark.createDataFrame([(1, EN, "en"), (2, DE, "de")], "doc_id long, text string, lang string")
    assert {r.trace_id for r in defective_pairs(traces, docs).where("defect_type = 'refusal'").collect()} == {0}
    assert not {r.trace_id for r in defective_pairs(traces.where("id < 2"), docs).where("defect_type = 'refusal'").collect()}


def test_classes_against_brute_force(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts = [" ".join([*base, "one"]), " ".join([*base, "two"]), " ".join(reversed(base)), "short text", "other"]
    got = {r.text: r.rep for r in classes(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert jaccard(texts[0], texts[1]) >= 0.8 and got[texts[0]] == got[texts[1]] and len(set(got.values())) == 4


def test_a_part_of_its_own_ends_the_copy_check(monkeypatch):
    """However many sentences an answer has, the first that isn't the question's settles it; a question's own parts are worked out once."""
    calls, plain = [], pairs.plain
    monkeypatch.setattr(pairs, "plain", lambda text: calls.append(text) or plain(text))
    q = "Say what the article finds. " * 40
    assert check(q, " ".join(f"The nurses saw {w} in it." for w in ["plums", "pears", "figs"] * 15), None, MODEL) is None
    before, shared = len(calls), pairs.Question(question(q), MODEL)
    assert before < 60
    for _ in range(20):
        assert check(q, EN, None, MODEL, asks=shared) is None
    assert len(calls) - before < 120
    assert check(q + "Name the wards.", "Name the wards. Say what the article finds.", None, MODEL) == "copy"


def test_tables_and_shortcuts_against_their_patterns():
    """Tables of signs keep what the patterns keep; short ways round a pattern give what the pattern gives."""
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for table, kept in [(pairs._PLAIN, r"[\p{L}\p{N}]"), (pairs._OPENING, r"[\p{L}' ]"), (lang._LETTERS, r"[\p{L}']")]:
        assert "".join(signs).translate(table) == regex.sub(rf"{kept}(*SKIP)(*FAIL)|.", " ", "".join(signs), flags=regex.S)
    draw = random.Random(5)
    odd = ["\u200b", "\n", "  ", "\x1c", "\xa0", "…", "...", "<|", "|>", "[cut", "(Truncated )", "</b>", "İs", "Σ", "½", "é", "> - a", '"', "`", "Task:", "Task: x", " word", "end.", ";", "–", "다"]
    for _ in range(3000):
        text = "".join(draw.choices(odd, k=draw.randint(1, 7)))
        assert pairs.blanks(text) == regex.sub(r"[\p{Cf}\p{Zs}\s]+", " ", text).strip()
        assert pairs.plain(text) == regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip()
        assert not (end := text.strip()) or not pairs._BROKEN.search(end) or end.endswith(pairs._BROKEN_ENDS) or "<|" in end
        assert pairs.bare_lines(text) == regex.sub(r"(?m)^[>\s\"'`*-]+|[\"'`*\s]+$", "", pairs._FENCE.sub("", text.strip()))
        task = regex.search(r"(?:^|\n)(?:Task|Question|Instruction)s?:\s*(.+?)\s*$", text, regex.S)
        assert task is None or question(text) == task[1].strip()


def test_runs_are_what_the_hashes_stand_for():
    for text in ("one", "a b c d", "a b c d e", "a b c d e a b c d e f", "x " * 20):
        assert {minhash.xxhash.xxh64_intdigest(" ".join(r)) for r in minhash.runs(text)} == set(minhash.shingles(text).tolist())


def test_word_scores_add_up():
    """Sums by word, each kept, are the sums over the grams of the whole text."""
    text = "The wards and the nurses. Die Klinik, l'été 2020 und the wards"
    found = [g for g in lang.grams(text) if g in MODEL.weights]
    sums, n = MODEL.scores(text)
    assert n == len(found) and all(abs(s - sum(MODEL.weights[g][i] for g in found)) < 1e-9 for i, s in enumerate(sums))
    assert MODEL.scores("12 — 3") == ([0.0, 0.0], 0) and MODEL.scores("the the")[1] == 2 * MODEL.scores("the")[1]
