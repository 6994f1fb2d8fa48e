"""The entity graph as plain edge and mention tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblion.functions.text import present

# Passive relation names and their active forms, which swap the ends.
ACTIVE_FORMS = {
    "developed by": "develops", "used by": "uses", "caused by": "causes", "influenced by": "influences", "regulated by": "regulates",
    "proposed by": "proposes", "applied by": "applies", "created by": "creates", "introduced by": "introduces", "evaluated by": "evaluates",
    "supported by": "supports", "funded by": "funds", "studied by": "studies", "addressed by": "addresses",
}
# Entity names that are matter of publication.
METADATA_NAMES = [
    "2024", "2025", "2026", "article", "articles", "author", "authors", "cc by", "cc by 4.0", "copyright", "creative commons",
    "creative commons attribution license", "creative commons attribution license cc-by 4.0", "creative commons license", "epub", "journal",
    "open access", "paper", "papers", "pmc", "pmc-last-change", "pmc-live", "pmc-release", "publication", "publications", "pubmed",
    "research article", "journal article", "jmir publications inc.", "nature publishing group", "scientific reports", "springer", "source", "sources",
]
# Order of types among synthesis candidates, and colours of types.
TYPE_ORDER = ["CONCEPT", "TECHNOLOGY", "METHODOLOGY", "REGULATION", "MEDICAL_CONDITION", "DATASET", "ORGANIZATION"]
TYPE_COLOURS = {
    "CONCEPT": "#5f92dc", "TECHNOLOGY": "#50aa84", "METHODOLOGY": "#ca8f3d", "DATASET": "#a57ccd", "ORGANIZATION": "#d27670",
    "REGULATION": "#769c5c", "MEDICAL_CONDITION": "#bc6f99",
}
MONTH = "january|february|march|april|may|june|july|august|september|october|november|december"


def wiki_entity(name: Column, kind: Column) -> Column:
    """Entities a wiki page may be made of."""
    n = F.lower(F.trim(name))
    dated = n.rlike(r"^[0-3][0-9] .* [12][0-9]{3}$") & n.rlike(MONTH)
    return (
        (F.upper(F.coalesce(kind, F.lit(""))) != "PERSON") & ~n.isin(*METADATA_NAMES)
        & ~n.rlike(r"^([12][0-9]{3}|pmc[0-9].*|pubmed[0-9].*|pmid[0-9].*|volume [0-9].*|issue [0-9].*|doi:.*|license:.*)$") & ~dated
    )


def _year(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^[0-9]{4}$") & token.between("1900", "2100"), F.lit(False))


def date_literal(name: Column) -> Column:
    """Whether a short text has a month's name, a year and a day."""
    n = F.lower(F.trim(name))
    parts = F.split(n, "[^0-9a-z]")
    return (F.octet_length(n) <= 40) & n.rlike(MONTH) & F.exists(parts, _year) & F.exists(parts, lambda t: t.rlike(r"^(0?[1-9]|[12][0-9]|3[01])$"))


def metadata_entity(name: Column) -> Column:
    """The stricter rule for extracted names."""
    n = F.lower(F.trim(name))
    return n.isNull() | (n == "") | n.isin(*METADATA_NAMES) | _year(n) | date_literal(name) | n.rlike(r"^(pmc|pubmed|pmid)[0-9]*$|^(doi:|license:|volume |issue )")


def reasonable_name(name: Column) -> Column:
    return F.length(F.trim(name)).between(2, 120) & name.rlike(r"\p{L}")


def canonical_relations(edges: DataFrame) -> DataFrame:
    """Relation names in normal form; passive ones become active and swap ``src`` and ``tgt``."""
    plain = F.regexp_replace(F.lower(F.trim("rel_type")), r"\s+", " ")
    active = F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTIVE_FORMS.items() for x in kv]), plain)
    return edges.withColumns({
        "src": F.when(active.isNull(), F.col("src")).otherwise(F.col("tgt")), "tgt": F.when(active.isNull(), F.col("tgt")).otherwise(F.col("src")),
        "rel_type": F.coalesce(active, plain),
    })


def fold_edges(observations: DataFrame) -> DataFrame:
    """Edges of (src, tgt, rel_type, seq, article, description): weight, articles in order of arrival, first description that says something.

    Observations are summed by edge and article first, so an edge's list holds each
    article once and a hot edge is added up in parts before its list is made.
    """
    spoken = F.nullif(F.trim("description"), F.lit(""))
    keys = ["src", "tgt", "rel_type"]
    each = observations.groupBy(*keys, "article").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.min(F.when(spoken.isNotNull(), F.struct("seq", F.col("description").alias("d")))).alias("said")
    )
    return each.groupBy(*keys).agg(
        F.sum("n").cast("double").alias("weight"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "article"))), lambda x: x["article"]).alias("articles"), F.min("said")["d"].alias("description")
    )


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges that became alike: weights add up (NULL as 1), articles unite, the longest description stays (the least id on ties).

    Articles are made distinct before they are listed.
    """
    keys = ["src", "tgt", "rel_type"]
    plain = canonical_relations(edges)
    told = F.struct(F.length(F.trim("description")).alias("n"), (-F.col("id")).alias("id"))
    summed = plain.groupBy(*keys).agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.max_by("description", told).alias("description"))
    each = plain.select(*keys, F.explode("articles").alias("article")).distinct()
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list("article")).alias("articles"))
    return summed.join(listed, keys, "left").withColumn("articles", F.coalesce("articles", F.array().cast(edges.schema["articles"].dataType)))


def both_ways(edges: DataFrame) -> DataFrame:
    """``node``, ``other``, ``rel_type``, ``weight`` from either end."""
    return edges.select(F.col("src").alias("node"), F.col("tgt").alias("other"), "rel_type", "weight").unionByName(
        edges.select(F.col("tgt").alias("node"), F.col("src").alias("other"), "rel_type", "weight")
    )


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("tgt"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node")).union(edges.select("tgt")).distinct(), "node", "left_anti")


def select_graph(edges: DataFrame, limit: int = 200) -> DataFrame:
    """Edges in order of weight while their ends fit ``limit`` nodes; later ones if both ends are in.

    The order decides, so the scan is sequential, over a bounded head of the order:
    ``limit`` x 8 edges, 200 to 10,000.
    """
    scan = min(max(limit * 8, 200), 10_000)
    head = edges.select("src", "tgt", "rel_type", "weight").orderBy(F.desc("weight"), "src", "tgt", "rel_type").limit(scan)

    def take(pdf):
        chosen: set[int] = set()
        keep = []
        for s, t in zip(pdf["src"], pdf["tgt"], strict=True):
            new = {s, t} - chosen
            ok = not new or len(chosen) + len(new) <= limit
            if ok:
                chosen |= new
            keep.append(ok)
        return pdf[keep]

    def run(frames):
        import pandas as pd

        frames = list(frames)
        if frames:
            pdf = pd.concat(frames).sort_values(["weight", "src", "tgt", "rel_type"], ascending=[False, True, True, True])
            yield take(pdf)

    return head.coalesce(1).mapInPandas(run, "src long, tgt long, rel_type string, weight double")


# The golden angle, and the least radius and the span of the spiral of ranks.
GOLDEN_ANGLE, INNER, SPAN = 2.399963229728653, 0.14, 0.82


def circle_layout(nodes: DataFrame) -> DataFrame:
    """Nodes of a bounded view (a graph page) evenly on a circle."""
    order = Window.orderBy("node")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    angle = F.lit(6.283185307179586) * (F.row_number().over(order) - 1) / n - F.lit(1.5707963267948966)
    return nodes.withColumns({"x": F.round(F.cos(angle) * 0.9, 6), "y": F.round(F.sin(angle) * 0.9, 6)})


def ring_layout(nodes: DataFrame) -> DataFrame:
    """Nodes of a bounded view on a spiral, those of most links in the middle."""
    order = Window.orderBy(F.desc("degree"), F.desc("mentions"), "node")
    rank = F.row_number().over(order) - 1
    last = F.greatest(F.count(F.lit(1)).over(Window.partitionBy()) - 1, F.lit(1))
    radius = F.when(rank == 0, 0.0).otherwise(INNER + SPAN * F.sqrt(rank / last))
    return nodes.withColumns({"x": F.round(radius * F.cos(rank * GOLDEN_ANGLE), 6), "y": F.round(radius * F.sin(rank * GOLDEN_ANGLE), 6)})


def spiral(nodes: DataFrame) -> DataFrame:
    """Nodes of a bounded view on a spiral by the golden angle, in order of ``node``: where a spring layout starts."""
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node")) - 1
    radius = F.sqrt((i + 0.5) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return nodes.withColumns({"x": F.round(F.cos(i * GOLDEN_ANGLE) * radius, 6), "y": F.round(F.sin(i * GOLDEN_ANGLE) * radius, 6)})


def layout_mode(asked: str | None) -> str:
    """The layout a name stands for; force where it stands for none."""
    # Names of the layouts.
    names = {"circle": ["circle", "circular"], "ring": ["ring", "rings", "radial", "concentric"], "force": ["force", "spring"]}
    return next((mode for mode, known in names.items() if (asked or "").strip().lower() in known), "force")


def force_layout(nodes: DataFrame, edges: DataFrame, rounds: int = 320, most: int = 2000) -> DataFrame:
    """Spring layout of a bounded view of at most ``most`` nodes; deterministic, coordinates within 0.96.

    Every pair pushes apart, edges (weight 0.1 to 100, no loops) pull together, all drift
    to the middle; a move is cut to a temperature that falls from round to round, of
    which there are the fewer the more nodes there are.
    """
    import numpy as np
    import pandas as pd

    ids = nodes.select("node").orderBy("node").limit(most)
    links = edges.select("src", "tgt", "weight").join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "tgt"), "tgt", "left_semi")
    tagged = ids.select(F.col("node").alias("src"), F.lit(None).cast("long").alias("tgt"), F.lit(None).cast("double").alias("weight")).unionByName(links)

    def place(frames):
        frames = list(frames)
        if not frames:
            return
        pdf = pd.concat(frames)
        names = np.sort(pdf.loc[pdf.tgt.isna(), "src"].unique())
        n = len(names)
        at = {x: i for i, x in enumerate(names)}
        e = pdf.dropna(subset=["tgt"])
        e = e[e.src != e.tgt].sort_values(["src", "tgt", "weight"])
        a, b = e.src.map(at).to_numpy(int), e.tgt.astype("int64").map(at).to_numpy(int)
        w = e.weight.fillna(1.0).clip(0.1, 100.0).to_numpy()
        i = np.arange(n)
        pos = np.column_stack([np.cos(i * GOLDEN_ANGLE), np.sin(i * GOLDEN_ANGLE)]) * np.sqrt((i[:, None] + 0.5) / max(n, 1))
        k = np.sqrt(1.0 / max(n, 1))
        steps = int(min(rounds, max(60, 40_000 // max(n, 1))))
        for step in range(steps):
            d = pos[:, None] - pos[None]
            r2 = np.maximum((d**2).sum(-1), 1e-4)
            move = (d * np.minimum(k * k / r2, 10.0)[..., None]).sum(1) - 0.02 * pos
            gap = pos[a] - pos[b]
            length = np.sqrt((gap**2).sum(1))
            pull = gap * np.minimum(length / k * np.log1p(w), 10.0)[:, None]
            np.add.at(move, a, -pull)
            np.add.at(move, b, pull)
            size = np.sqrt((move**2).sum(1, keepdims=True)) + 1e-9
            pos = pos + move / size * np.minimum(size, 0.1 * (1 - step / steps))
        pos = pos - pos.mean(0)
        pos = pos / max(np.abs(pos).max(), 1e-9) * 0.96
        yield pd.DataFrame({"node": names, "x": pos[:, 0].round(6), "y": pos[:, 1].round(6)})

    return tagged.coalesce(1).mapInPandas(place, "node long, x double, y double")


def with_vectors(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entities joined to the vectors (id, type) of their id and type, whatever the type's case."""
    v = vectors.withColumn("__type", F.lower("type")).drop("type")
    return entities.withColumn("__type", F.lower("kind")).join(v, ["id", "__type"]).drop("__type")


def workspace_entities(mentions: DataFrame, articles: DataFrame, workspace: int) -> DataFrame:
    """``id`` of the entities that an article of the workspace mentions."""
    own = articles.where(F.col("workspace_id") == workspace).select(F.col("uid").alias("article_uid"))
    return mentions.join(own, "article_uid", "left_semi").select(F.col("entity_id").alias("id")).distinct()


def scoped_edges(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """Edges with both ends in the scope."""
    return edges.join(scope.withColumnRenamed("id", "src"), "src", "left_semi").join(scope.withColumnRenamed("id", "tgt"), "tgt", "left_semi").select(*edges.columns)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part``, ``n``: nodes, edges, and nodes of each type."""
    n = F.count(F.lit(1)).alias("n")
    kinds = nodes.groupBy(F.coalesce("kind", F.lit("UNKNOWN")).alias("part")).agg(n)
    return nodes.agg(n).select(F.lit("nodes").alias("part"), "n").unionByName(edges.agg(n).select(F.lit("edges").alias("part"), "n")).unionByName(kinds)


def progress(rows: DataFrame, done: Column, *by: str) -> DataFrame:
    """``total``, ``done`` and ``remaining`` (never below 0), by group if asked."""
    n_done = F.sum(F.coalesce(done, F.lit(False)).cast("long"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), n_done.alias("done"), F.greatest(F.count(F.lit(1)) - n_done, F.lit(0)).alias("remaining"))


def valid_extraction(entities: Column, relations: Column) -> Column:
    """What of an extraction holds: entities with a fit name, a type and a description of 15 characters, once each, and relations between these."""
    fit = lambda e: reasonable_name(e["name"]) & ~metadata_entity(e["name"]) & present(e["entity_type"]).isNotNull() & (F.length(F.trim(F.coalesce(e["description"], F.lit("")))) >= 15)
    names = F.array_distinct(F.transform(F.filter(entities, lambda e: F.coalesce(fit(e), F.lit(False))), lambda e: F.trim(e["name"])))
    known = lambda x: F.coalesce(F.array_contains(names, F.trim(x)), F.lit(False))
    return F.struct(names.alias("entities"), F.filter(relations, lambda r: known(r["source"]) & known(r["target"])).alias("relations"))


def valid_synthesis(summary: Column, synthesis: Column) -> Column:
    return F.coalesce(present(summary).isNotNull() & (F.length(F.trim(synthesis)) >= 80), F.lit(False))


def _top(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)


def latest_mentions(mentions: DataFrame, articles: DataFrame, most: int) -> DataFrame:
    """The latest mentions of every entity, with title and author of their articles."""
    a = articles.select(F.col("uid").alias("article_uid"), "title", "first_author")
    return _top(mentions.join(a, "article_uid"), ["entity_id"], [F.desc("mention_id")], most)


def latest_sources(mentions: DataFrame, articles: DataFrame, most: int) -> DataFrame:
    """The latest places (uid, chunk_index) that mention an entity."""
    a = articles.select("uid", "title", "reg_date")
    places = mentions.select("entity_id", F.col("article_uid").alias("uid"), "chunk_index").distinct().join(a, "uid")
    return _top(places, ["entity_id"], [F.desc_nulls_last("reg_date"), F.asc("uid"), F.asc("chunk_index")], most)


def mention_entry() -> Column:
    """A mention as an entry of a context: title, author and what stands there."""
    return F.concat(
        F.lit('### From "'), F.coalesce("title", F.lit("Unknown Article")), F.lit('" ('), F.coalesce("first_author", F.lit("Unknown")), F.lit(")\n"), F.coalesce("context", F.lit("(no context)")), F.lit("\n\n")
    )


def shared_contexts(edges: DataFrame, mentions: DataFrame, articles: DataFrame, most: int, size: int) -> DataFrame:
    """``contexts`` of edges (src, tgt, rel_type): what articles that mention both ends say, the latest ``most`` within ``size`` bytes."""
    keys = ["src", "tgt", "rel_type"]
    by = mentions.select("entity_id", "article_uid").distinct()
    both = edges.join(by.withColumnRenamed("entity_id", "src"), "src").join(by.withColumnRenamed("entity_id", "tgt"), ["tgt", "article_uid"])
    ends = both.select(*keys, "article_uid", F.explode(F.array_distinct(F.array("src", "tgt"))).alias("entity_id"))
    found = ends.join(mentions.select("entity_id", "article_uid", "mention_id", "context"), ["entity_id", "article_uid"]).join(articles.select(F.col("uid").alias("article_uid"), "title", "first_author"), "article_uid")
    entries = found.groupBy(*keys, mention_entry().alias("entry")).agg(F.max("mention_id").alias("last"))
    top = _top(entries, keys, [F.desc("last")], most)
    run = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = top.withColumn("used", F.sum(F.octet_length("entry")).over(run)).where(F.col("used") <= size)
    rows = F.array_sort(F.collect_list(F.struct("rank", "entry")))  # at most ``most``
    return fits.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["entry"]), "").alias("contexts"))


def to_compile(entities: DataFrame, syntheses: DataFrame) -> DataFrame:
    """Entities without a synthesis, or with a stale one."""
    s = syntheses.select(F.col("entity_id").alias("id"), F.coalesce("stale", F.lit(False)).alias("stale"), F.lit(True).alias("there"))
    return entities.join(s, "id", "left").where("there is null or stale")


def looked_up(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """``q``, ``id``, ``rank``: the entity each of a few names stands for (1 whole name, 2 part of it, 3 alias), the most mentioned, the least id."""
    n = F.lower("name")
    low = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.lower(x))
    hit = entities.join(F.broadcast(asked), n.contains(F.col("q")) | F.exists(low, lambda x: x.contains(F.col("q"))))
    hit = hit.withColumn("rank", F.when(n == F.col("q"), 1).when(n.contains(F.col("q")), 2).otherwise(3))
    w = Window.partitionBy("q").orderBy("rank", F.desc(F.coalesce("mention_count", F.lit(0))), "id")
    return hit.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("q", "id", "rank")


def listed_syntheses(syntheses: DataFrame, entities: DataFrame, limit: int, least: int = 3) -> DataFrame:
    e = entities.where(wiki_entity(F.col("name"), F.col("kind"))).select(F.col("id").alias("entity_id"), "name", "mention_count")
    kept = syntheses.where(F.col("n_articles") >= least).join(e, "entity_id")
    return kept.orderBy(F.desc("stale"), F.desc("n_articles"), F.desc(F.coalesce("mention_count", F.lit(0))), "entity_id").limit(limit)


def type_priority(kind: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for i, t in enumerate(TYPE_ORDER):
        out = out.when(F.upper(kind) == t, i + 1)
    return out.otherwise(len(TYPE_ORDER) + 1)


def synthesis_candidates(entities: DataFrame, mentions: DataFrame, limit: int, least: int = 3) -> DataFrame:
    """Wiki entities of ``least`` articles or more: those of most articles first, then by type, mentions and name."""
    n = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("article_uid").alias("n_articles")).where(F.col("n_articles") >= least)
    e = entities.where(wiki_entity(F.col("name"), F.col("kind"))).withColumn("priority", type_priority(F.col("kind")))
    return e.join(n, "id").orderBy(F.desc("n_articles"), "priority", F.desc(F.coalesce("mention_count", F.lit(0))), "name", "id").limit(limit)


def evidence_candidates(edges: DataFrame, most: int) -> DataFrame:
    """Of each entity its strongest edges without evidence (src, tgt, rel_type, weight, evidence)."""
    open_ = edges.where(present(F.col("evidence")).isNull())
    ends = open_.withColumn("entity", F.explode(F.array_distinct(F.array("src", "tgt"))))
    return _top(ends, ["entity"], [F.desc("weight"), F.asc("src"), F.asc("tgt"), F.asc("rel_type")], most)


def graph_answer(asked: str, entities: DataFrame, edges: DataFrame, mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """What the graph knows of a name, as rows (part, a, b, c): 12 entities, 40 edges, 8 sources, the context of the first 5."""
    q, n = asked.strip().lower(), F.lower("name")
    low = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.lower(x))
    fit = F.when(n == q, 0).when(n.startswith(q), 1).otherwise(2)
    found = entities.where(n.contains(q) | F.exists(low, lambda x: x.contains(q))).orderBy(fit, F.desc(F.coalesce("mention_count", F.lit(0))), "name", "id").limit(12)
    ids = F.broadcast(found.select("id"))  # twelve rows
    near = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "tgt"), "tgt", "left_semi")).distinct()
    top = near.orderBy(F.desc("weight"), "src", "tgt", "rel_type").limit(40)
    places = mentions.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").select(F.col("article_uid").alias("uid"), "chunk_index").distinct()
    order = [F.desc_nulls_last("reg_date"), F.asc("uid"), F.asc("chunk_index")]
    sources = places.join(articles.select("uid", "title", "reg_date"), "uid").orderBy(*order).limit(8)
    ranked = sources.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # eight rows
    rows = F.array_sort(F.collect_list(F.struct("r", F.coalesce("title", F.lit("")).alias("t"))))
    text = ranked.where("r <= 5").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n").alias("c"))
    part = lambda df, name, a, b, c: df.select(F.lit(name).alias("part"), a.cast("string").alias("a"), b.cast("string").alias("b"), c.alias("c"))
    return (
        part(found, "entity", F.col("id"), F.col("name"), F.lit(""))
        .unionByName(part(top, "edge", F.col("src"), F.col("tgt"), F.col("rel_type")))
        .unionByName(part(ranked, "source", F.col("uid"), F.col("chunk_index"), F.coalesce("title", F.lit(""))))
        .unionByName(part(text, "context", F.lit(""), F.lit(""), F.col("c")))
    )


def gap_lines(nodes: DataFrame, edges: DataFrame, inside: DataFrame, syntheses: DataFrame) -> DataFrame:
    """Lines (part, line) a search for gaps starts from: 30 entities with what is known of them, types, 10 relations, 10 entities without any edge."""
    line = lambda df, part, text: df.select(F.lit(part).alias("part"), F.concat(F.lit("- "), text).alias("line"))
    kind = F.coalesce("kind", F.lit("UNKNOWN"))
    s = syntheses.select(F.col("entity_id").alias("id"), "summary")
    top = nodes.join(s, "id", "left").orderBy(F.desc(F.coalesce("mention_count", F.lit(0))), "id").limit(30)
    n = F.count(F.lit(1)).alias("n")
    rels = inside.groupBy("rel_type").agg(n).orderBy(F.desc("n"), "rel_type").limit(10)
    alone = isolated(nodes.withColumnRenamed("id", "node"), edges).orderBy("node").limit(10)
    return (
        line(top, "top", F.concat("name", F.lit(" ["), kind, F.lit("]: "), F.coalesce("summary", "description", F.lit(""))))
        .unionByName(line(nodes.groupBy(kind.alias("kind")).agg(n), "type", F.concat_ws(": ", "kind", F.col("n").cast("string"))))
        .unionByName(line(rels, "relation", F.concat_ws(": ", "rel_type", F.col("n").cast("string"))))
        .unionByName(line(alone, "isolated", F.col("name")))
    )


def extra_nodes(nodes: DataFrame, degree: DataFrame, taken: DataFrame, most: int) -> DataFrame:
    """Wiki entities that fill a view up: by mentions, degree and name."""
    free = nodes.where(wiki_entity(F.col("name"), F.col("kind"))).join(taken, "id", "left_anti").join(degree.withColumnRenamed("node", "id"), "id", "left")
    zero = lambda c: F.desc(F.coalesce(c, F.lit(0)))
    return free.orderBy(zero("mention_count"), zero("degree"), "name", "id").limit(most)


def node_properties(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """``id`` and ``node``: name, labels and properties as a graph view shows them."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    props = F.struct("description", zero("degree").alias("degree"), zero("mention_count").alias("mention_count"))
    joined = nodes.join(degree.withColumnRenamed("node", "id"), "id", "left")
    return joined.select("id", F.struct("name", F.array(F.coalesce("kind", F.lit("UNKNOWN"))).alias("labels"), props.alias("properties")).alias("node"))


def graph_view(nodes: DataFrame, edges: DataFrame, limit: int = 200, min_degree: int = 0, kinds: list[str] | None = None, scan: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A view of the scoped graph: nodes (``id``) and edges.

    Candidate edges join nodes of ``min_degree`` and the asked types, strongest first
    (then by names), a bounded head of them; edges are taken while their ends fit
    ``limit`` nodes. With ``min_degree`` 0 nodes without an edge fill the view up.
    """
    degree = degrees(edges)
    kept = nodes.join(degree.withColumnRenamed("node", "id"), "id", "left").where(F.coalesce("degree", F.lit(0)) >= min_degree)
    if kinds:
        kept = kept.where(F.upper(F.coalesce("kind", F.lit(""))).isin(kinds))
    end = lambda side: kept.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    head = edges.join(end("src"), "src").join(end("tgt"), "tgt").orderBy(F.desc(F.coalesce("weight", F.lit(1.0))), "src_name", "tgt_name", "rel_type").limit(scan or min(max(limit * 8, 200), 10_000))
    chosen = _taken(head, limit)
    ids = chosen.select(F.col("src").alias("id")).union(chosen.select("tgt")).distinct()
    if min_degree == 0:
        zero = lambda c: F.desc(F.coalesce(c, F.lit(0)))
        more = extra_nodes(kept.drop("degree"), degree, ids, limit)
        more = more.withColumn("o", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(zero("mention_count"), zero("degree"), "name", "id")))
        ids = ids.withColumn("o", F.lit(0)).unionByName(more.select("id", "o")).orderBy("o").limit(limit).select("id")
    return ids, chosen


def _taken(head: DataFrame, limit: int) -> DataFrame:
    """Edges of a bounded head in order, while their ends fit; the order decides, so one task reads it."""

    def run(frames):
        import pandas as pd

        frames = list(frames)
        if not frames:
            return
        pdf = pd.concat(frames)
        pdf["weight"] = pdf["weight"].fillna(1.0)
        pdf = pdf.sort_values(["weight", "src_name", "tgt_name", "rel_type"], ascending=[False, True, True, True])
        seen: set[int] = set()
        keep = []
        for ends in zip(pdf["src"], pdf["tgt"], strict=True):
            new = set(ends) - seen
            keep.append(len(seen) + len(new) <= limit)
            if keep[-1]:
                seen |= new
        yield pdf.loc[keep, ["src", "tgt", "rel_type", "weight"]]

    return head.select("src", "tgt", "rel_type", "weight", "src_name", "tgt_name").coalesce(1).mapInPandas(run, "src long, tgt long, rel_type string, weight double")
