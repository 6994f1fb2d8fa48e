"""Steps that ask a text-generation service: the caller gives a function from prompts to answers; nothing here talks to one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblion.functions.text import json_payload, present

#: From prompts to answers, of the same length and order; None where there was none.
Completer = Callable[[list[str]], list[str | None]]


def completed(rows: DataFrame, key: str, prompt: str, complete: Completer, attempts: int = 2) -> DataFrame:
    """``key``, ``answer`` and ``status`` (done or failed): each prompt asked, and once more if no JSON came back.

    A batch that raises counts as one without answers; no row is lost.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        def fits(x: str | None) -> bool:
            try:
                return x is not None and isinstance(json.loads(x), (dict, list))
            except ValueError:
                return False

        for batch in batches:
            asked = batch.column(1).to_pylist()
            answers: list[str | None] = [None] * len(asked)
            for _ in range(attempts):
                open_ = [i for i, x in enumerate(answers) if asked[i] is not None and not fits(x)]
                if not open_:
                    break
                try:
                    for i, x in zip(open_, complete([asked[i] for i in open_]), strict=True):
                        answers[i] = x
                except Exception:  # noqa: BLE001 (whatever the service raises, the rows go on as failed)
                    continue
            status = ["done" if fits(x) else "failed" for x in answers]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x if s == "done" else None for x, s in zip(answers, status, strict=True)], pa.string()), pa.array(status)], names=[key, "answer", "status"])

    return rows.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, answer string, status string")


def extracted_graph(answers: DataFrame, key: str) -> DataFrame:
    """Entities and relations of answers, as arrays; answers that don't fit give none."""
    schema = "entities array<struct<name:string,entity_type:string,description:string>>, relationships array<struct<source:string,target:string>>"
    j = F.from_json(json_payload(F.col("answer")), schema)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return answers.select(
        key, empty(j["entities"], "array<struct<name:string,entity_type:string,description:string>>").alias("entities"), empty(j["relationships"], "array<struct<source:string,target:string>>").alias("relations")
    )


def verdicts(answers: DataFrame, key: str, least: float = 0.82) -> DataFrame:
    """Whether two names are one entity: the answer says so with a confidence of ``least`` or more."""
    j = F.from_json("answer", "same_entity boolean, confidence double")
    return answers.select(key, F.coalesce(j["same_entity"] & (j["confidence"] >= least), F.lit(False)).alias("same"))


def counts(statuses: DataFrame) -> DataFrame:
    """Counters of a loop: processed, compiled, failed."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return statuses.agg(F.count(F.lit(1)).alias("processed"), n("done").alias("compiled"), n("failed").alias("failed"))


def start(eligible: DataFrame, running: Column, batch: int) -> DataFrame:
    """What a request to start a loop gets: conflict while one runs, skipped if nothing is eligible, else the size of its batch."""
    n = eligible.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.when(running, "conflict").when(F.col("n") == 0, "skipped").otherwise("started").alias("status"), F.when(running, 0).otherwise(F.least("n", F.lit(batch))).alias("batch"))


def context(sources: DataFrame, by: str, order: str, text: str, most: int = 5) -> DataFrame:
    """The first sources of each group as one text, a blank line between."""
    from biblion.operators.retrieval import top_per

    head = top_per(sources.where(present(F.col(text)).isNotNull()), [by], [F.asc(order)], most)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))  # at most ``most``
    return head.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("context"))


def gap_text(issues: DataFrame, by: str, order: str) -> DataFrame:
    """Issues (issue, confidence) of each gap as lines, the confidence in two places."""
    line = F.concat(F.lit("- "), F.col("issue"), F.format_string(" (confidence %.2f)", F.col("confidence")))
    rows = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))  # the findings of one gap
    return issues.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("issues"))


def response_format(schema: dict | None, compatible: bool, name: str = "answer") -> str:
    """How a service is asked for JSON: by a schema, or as any object where there is none or it knows no schemas."""
    import json

    asked = {"type": "json_object"} if compatible or not schema else {"type": "json_schema", "json_schema": {"name": name, "schema": schema}}
    return json.dumps(asked, separators=(",", ":"))
