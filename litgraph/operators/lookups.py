"""Joins that find entities and the rows around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import norm
from ..model import ENTITY_TYPES, Library
from ..session import broadcast_if_small, cut
from .filters import source_edges
from .graph import both_ways, live, rank_in, redirect_closure


def alias_index(lib: Library) -> DataFrame:
    """(type, norm, key): one entity per name and type, the lowest id when several carry it."""
    named = lib.alias.filter(F.length("norm") > 0).join(
        lib.entity.select(F.col("key").alias("entity_key"), "type", "id"), "entity_key")
    return named.groupBy("type", "norm").agg(F.min_by("entity_key", "id").alias("key"))


def by_alias(lib: Library, probes: DataFrame) -> DataFrame:
    """probes(type, norm, ...) with the entity of that name, null when there is none."""
    return probes.join(alias_index(lib), ["type", "norm"], "left")


def last_redirects(merges: DataFrame) -> DataFrame:
    """(key, into): the last active merge of each source key; merges(id, from_key, into_key)."""
    return merges.groupBy(F.col("from_key").alias("key")).agg(F.max_by("into_key", "id").alias("into"))


def redirect_map(merges: DataFrame) -> DataFrame:
    return redirect_closure(last_redirects(merges).filter(F.col("key") != F.col("into")))


def follow(df: DataFrame, redirects: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by the end of its redirect chain."""
    r = redirects.select(F.col("key").alias(column), F.col("target").alias("_to"))
    return df.join(r, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def by_external_id(lib: Library, probes: DataFrame) -> DataFrame:
    """probes(type, external_id, ...) with the anchored entity."""
    anchors = lib.entity.filter(F.col("external_id").isNotNull()).groupBy("type", "external_id").agg(
        F.min_by("key", "id").alias("key"))
    return probes.join(anchors, ["type", "external_id"], "left")


def first_match(probes: DataFrame, key: str, *lookups: DataFrame) -> DataFrame:
    """The best of several lookups per probe. Each lookup has (key, prio, id, found); the lowest
    priority number wins, then the lowest id."""
    allof = lookups[0]
    for df in lookups[1:]:
        allof = allof.unionByName(df)
    best = allof.groupBy(key).agg(F.min(F.struct("prio", "id", "found")).alias("m"))
    return probes.join(best, key, "left").select(*[c for c in probes.columns], F.col("m.found").alias("found"),
                                                 F.col("m.prio").alias("prio"))


def resolve_ref(lib: Library, refs: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """refs(ref): what a person types for an entity. A key, then a DOI, a repository, an external id,
    then a name in the fixed order of types."""
    r = refs.select("ref").distinct().filter(F.length(F.trim("ref")) > 0)
    r = r.select("ref", F.trim("ref").alias("t"), norm(F.trim("ref")).alias("n"),
                 ids.doi(F.trim("ref")).alias("doi"), ids.repo(F.trim("ref")).alias("repo"))
    ent = lib.entity.select("id", "key", "type", "external_id")
    keyed = r.withColumn("k", F.col("t"))
    if redirects is not None:
        keyed = follow(keyed, redirects, "k")
    al = lib.alias.select(F.col("entity_key").alias("key"), "norm").join(ent.select("key", "id", "type"), "key")

    def hit(df: DataFrame, prio: Column) -> DataFrame:
        return df.select("ref", prio.cast("int").alias("prio"), "id", F.col("key").alias("found"))

    order = F.create_map(*[x for i, e in enumerate(ENTITY_TYPES) for x in (F.lit(e), F.lit(10 + i))])
    good_doi, good_repo = r.filter(F.col("doi").isNotNull()), r.filter(F.col("repo").isNotNull())
    return first_match(
        refs, "ref",
        hit(keyed.join(ent, keyed.k == ent.key), F.lit(1)),
        hit(good_doi.join(ent, F.concat(F.lit("work:doi:"), "doi") == ent.key), F.lit(2)),
        hit(good_doi.join(al.filter("type = 'work'"), F.col("doi") == F.col("norm")), F.lit(3)),
        hit(good_repo.join(ent, F.concat(F.lit("method:repo:"), "repo") == ent.key), F.lit(4)),
        hit(good_repo.join(ent.filter("type = 'method'"), F.col("repo") == F.col("external_id")), F.lit(5)),
        hit(r.join(ent, F.col("t") == F.col("external_id")), F.lit(6)),
        hit(r.join(al, F.col("n") == F.col("norm")), order[F.col("type")]))


def find_existing(lib: Library, idents: DataFrame) -> DataFrame:
    """idents(ident, title): the paper an identifier or title names; DOI, preprint DOI, name, title. All four are looked up
    in one join, against keys and names that keep their first paper only."""
    doi, adoi, n, tn = ids.doi(F.trim("ident")), ids.arxiv_doi(F.trim("ident")), norm(F.trim("ident")), norm(F.trim("title"))
    key = lambda c: F.concat(F.lit("key|work:doi:"), c)
    name = lambda c: F.when(F.length(c) > 0, F.concat(F.lit("name|"), c))
    asked = F.array(*[F.struct(F.lit(prio).alias("prio"), x.alias("what")) for prio, x in enumerate((key(doi), key(adoi), name(n), name(tn)), 1)])
    asked = idents.select("ident", F.explode(asked).alias("x")).select("ident", "x.prio", "x.what").filter("what is not null")
    works = lib.entity.filter("type = 'work'").select("id", "key")
    by_doi = works.filter("key like 'work:doi:%'").select(F.concat(F.lit("key|"), "key").alias("what"), "id", "key")
    by_name = lib.alias.select(F.col("entity_key").alias("key"), "norm").join(works, "key").select(F.concat(F.lit("name|"), "norm").alias("what"), "id", "key")
    first = by_doi.unionByName(by_name).groupBy("what").agg(F.min(F.struct("id", "key")).alias("m"))
    return first_match(idents, "ident", asked.join(first, "what").select("ident", "prio", F.col("m.id").alias("id"), F.col("m.key").alias("found")))


def source_works(lib: Library, keys: DataFrame | None = None) -> DataFrame:
    """(key, work_key, title, year, edge_type, evidence): the papers behind each entity, one row each."""
    e = source_edges(lib)
    if keys is not None:
        e = e.join(keys.select(F.col("key").alias("dst")), "dst", "left_semi")
    works = lib.work.select(F.col("entity_key").alias("src"), "year")
    names = lib.entity.select(F.col("key").alias("src"), F.col("canonical_name").alias("title"))
    return e.join(works, "src").join(names, "src").select(
        F.col("dst").alias("key"), F.col("src").alias("work_key"), "title", "year", F.col("type").alias("edge_type"), "evidence")


def with_year(lib: Library, entity: DataFrame) -> DataFrame:
    return entity.join(lib.work.select(F.col("entity_key").alias("key"), "year"), "key", "left")


def same_title(probes: DataFrame, papers: DataFrame) -> DataFrame:
    """probes(id, title, year) with the earliest paper of the same lower-case title whose year is
    within one, a missing year matching any. papers(id, title, year). The tolerance is three equal
    years per probe, so the join stays an equi-join however often a title repeats."""
    title = F.lower(F.trim("title"))
    per_year = papers.groupBy(title.alias("t"), F.col("year").alias("y")).agg(F.min("id").alias("m"), F.count("*").alias("n"))
    per_title = per_year.groupBy("t").agg(F.min("m").alias("m"), F.sum("n").alias("n"))
    p = probes.select("id", title.alias("t"), "year")
    dated = p.filter("year is not null").withColumn("y", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)))
    near = (dated.join(per_year.filter("y is not null"), ["t", "y"]).select("id", "m", "n")
            .unionByName(p.filter("year is not null").join(per_year.filter("y is null"), "t").select("id", "m", "n"))
            .unionByName(p.filter("year is null").join(per_title, "t").select("id", "m", "n")))
    return near.groupBy("id").agg(F.min("m").alias("match_id"), F.sum("n").alias("matches"))


def citations(records: DataFrame, works: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """cites(src, dst) among known papers; records(id, referenced_works), works(metadata_id, key). With
    ``only`` (key) just the edges that touch those papers."""
    by_id = works.filter("metadata_id is not null").groupBy("metadata_id").agg(F.min("key").alias("key"))
    refs = records.select("id", F.explode("referenced_works").alias("ref")).distinct()
    out = (refs.join(by_id.select(F.col("metadata_id").alias("id"), F.col("key").alias("src")), "id")
           .join(by_id.select(F.col("metadata_id").alias("ref"), F.col("key").alias("dst")), "ref")
           .filter("src != dst").select("src", "dst").distinct())
    if only is not None:
        k = only.select("key")
        a = out.join(k.withColumnRenamed("key", "src"), "src", "left_semi")
        b = out.join(k.withColumnRenamed("key", "dst"), "dst", "left_semi")
        out = a.select("src", "dst").unionByName(b.select("src", "dst")).distinct()
    return out


def sharing_papers(lib: Library, probes: DataFrame, types: tuple[str, ...] = ("topic", "dataset", "method")) -> DataFrame:
    """(probe, dst, dtype, other, etype): rows other papers share with each probe paper. Probes are a
    bounded set, so the join is linear in the edges however large a shared hub is."""
    e = live(lib.edge)
    targets = lib.entity.filter(F.col("type").isin(*types)).select(F.col("key").alias("dst"), F.col("type").alias("dtype"))
    mine = (e.join(probes.select(F.col("key").alias("src")), "src", "left_semi")
            .select(F.col("src").alias("probe"), "dst").distinct().join(targets, "dst"))
    return (mine.join(e.select("dst", F.col("src").alias("other"), F.col("type").alias("etype")), "dst")
            .filter(F.col("other") != F.col("probe")))


def shared_material(lib: Library, a: str, b: str) -> DataFrame:
    """Sources tagged with both topics."""
    tags = live(lib.edge).filter(F.col("type").isin("about", "applicable_to") & F.col("dst").isin(a, b))
    return tags.groupBy(F.col("src").alias("key")).agg(F.countDistinct("dst").alias("n")).filter("n = 2").select("key")


def dataset_info(lib: Library, accessions: DataFrame) -> DataFrame:
    """accessions(accession) -> dataset, paper, role and evidence; rejected datasets give nothing."""
    d = lib.entity.filter("type = 'dataset' and status != 'rejected'").select("key", "external_id", "canonical_name")
    d = d.join(accessions.select(F.col("accession").alias("external_id")), "external_id", "left_semi")
    works = lib.entity.filter("type = 'work'").select(F.col("key").alias("src"))
    e = live(lib.edge).join(works, "src", "left_semi")
    return d.join(e, d.key == e.dst).select("external_id", "canonical_name", F.col("src").alias("work_key"),
                                            F.col("type").alias("edge_type"), "evidence")


def queue_context(lib: Library, items: DataFrame, sides: list[str], max_aliases: int = 8, max_edges: int = 3) -> DataFrame:
    """items(id, <side columns>) -> (id, side, key, aliases, edges): the first aliases and live edges of
    each side. Only the keys asked for are ranked, and the ranks cut before anything is collected; items meet what is
    known of their keys, not the tables."""
    asked = None
    for s in sides:
        one = items.filter(F.col(s).isNotNull()).select("id", F.lit(s).alias("side"), F.col(s).alias("key"))
        asked = one if asked is None else asked.unionByName(one)
    keys = cut(asked.select("key").distinct())
    wanted = broadcast_if_small(keys)
    al = (lib.alias.select(F.col("entity_key").alias("key"), "alias").join(wanted, "key", "left_semi")
          .withColumn("r", rank_in(["key"], [F.col("alias")])).filter(F.col("r") <= max_aliases)
          .groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("aliases")))
    ends = both_ways(live(lib.edge), "type", "created_at").withColumnRenamed("node", "key").join(wanted, "key", "left_semi")
    ed = (ends.withColumn("r", rank_in(["key"], [F.col("created_at"), F.col("other"), F.col("type")]))
          .filter(F.col("r") <= max_edges)
          .groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.concat("type", F.lit(">"), "other"))), ",").alias("edges")))
    known = cut(lib.entity.select("key").join(wanted, "key", "left_semi").distinct().join(al, "key", "left").join(ed, "key", "left"))
    return (asked.join(broadcast_if_small(known), "key")
            .select("id", "side", "key", F.coalesce("aliases", F.lit("")).alias("aliases"), F.coalesce("edges", F.lit("")).alias("edges")))


def question_key(scorer: str, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", F.lit(scorer), *parts), 256), 1, 48)


def with_verdicts(questions: DataFrame, memo: DataFrame) -> DataFrame:
    """questions(qkey, ...) with the remembered verdict, null when it was never asked."""
    return questions.join(memo.select("qkey", "verdict"), "qkey", "left")


def to_judge(questions: DataFrame, memo: DataFrame, limit: int) -> DataFrame:
    """What a paid judge still has to answer, best score first."""
    return (questions.join(memo.select("qkey"), "qkey", "left_anti")
            .orderBy(F.desc("score"), F.asc("id")).limit(limit))


def with_cached_vectors(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """texts(..., text) with the cached vector of the same text and model; null means embed it."""
    c = cache.filter(F.col("model") == model).select("text_sha", "vec")
    return texts.withColumn("text_sha", F.sha2("text", 256)).join(c, "text_sha", "left")


def edge_order() -> list[Column]:
    """Confirmed first, then automatic, then the rest; ties by time and key."""
    rank = F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "auto", 1).otherwise(2)
    return [rank, F.col("created_at"), F.col("node"), F.col("other")]


def edge_pages(lib: Library, keys: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """(node, direction, type, rn, other, ...): a page of edges per node, type and direction."""
    e = lib.edge
    cols = ["type", "status", "confidence", "evidence", "created_at"]
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction"), *cols)
    inn = e.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("direction"), *cols)
    both = out.unionByName(inn)
    if keys is not None:
        both = both.join(keys.select(F.col("key").alias("node")), "node", "left_semi")
    rn = rank_in(["node", "direction", "type"], edge_order())
    return both.withColumn("rn", rn).filter(F.col("rn") <= offset + limit).filter(F.col("rn") > offset)


def edge_counts(lib: Library, keys: DataFrame | None = None) -> DataFrame:
    """(key, type, n): both directions summed."""
    e = both_ways(lib.edge, "type").withColumnRenamed("node", "key")
    if keys is not None:
        e = e.join(keys.select("key"), "key", "left_semi")
    return e.groupBy("key", "type").agg(F.count("*").alias("n"))


def entity_names(lib: Library, keys: DataFrame) -> DataFrame:
    """(key, alias): every distinct name of the entities, as rows."""
    own = lib.alias.join(keys.select(F.col("key").alias("entity_key")), "entity_key", "left_semi")
    return own.select(F.col("entity_key").alias("key"), "alias").distinct()


def entity_cards(lib: Library, keys: DataFrame, per_type: int = 50) -> DataFrame:
    """One row per key: edge totals, the first edges per type and direction, year and tier; its names are rows of
    ``entity_names``."""
    pages = edge_pages(lib, keys, per_type)
    first = pages.groupBy(F.col("node").alias("key")).agg(
        F.array_sort(F.collect_list(F.struct("type", "direction", "rn", "other", "status", "evidence"))).alias("edges"))
    counts = edge_counts(lib, keys).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("type", "n"))).alias("edge_counts"))
    work = lib.work.select(F.col("entity_key").alias("key"), "year", "tier")
    return (lib.entity.join(keys.select("key"), "key", "left_semi").join(first, "key", "left")
            .join(counts, "key", "left").join(work, "key", "left"))
