"""From checked documents to the graph: mentions, resolved entities, edges, attributes, cards, questions.

Everything is exploded once per list and joined back by key; no document is ever held whole on the
driver, and no step depends on the order rows arrive in, only on (extraction id, place in document)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.entity import entity_text
from ..functions.keys import card_id, work_key
from ..functions.scoring import strength
from ..functions.text import alias_language, has_han, norm
from ..operators import rollups as ru
from ..operators.graph import components
from ..operators.judging import Judge, Reranker
from ..operators.lookups import first_match
from ..operators.ranking import top_per
from ..operators.resolution import Resolved, Thresholds, resolve
from ..session import cut, stored

MENTION = ["mid", "eid", "type", "name", "aliases", "origin", "local_id", "anchor", "auto", "seq", "attrs"]
NO_MAP = "cast(map() as map<string,string>)"
# The controlled vocabulary of measurement types.
MODALITIES = (
    ("scRNA-seq", "single-cell RNA-seq", "single cell RNA sequencing", "scRNAseq", "单细胞转录组"),
    ("snRNA-seq", "single-nucleus RNA-seq", "single nucleus RNA sequencing", "snRNAseq", "单细胞核转录组"),
    ("scATAC-seq", "single-cell ATAC-seq", "snATAC-seq", "scATACseq"),
    ("bulk RNA-seq", "RNA-seq", "RNAseq", "transcriptome sequencing", "转录组测序"),
    ("ATAC-seq", "ATACseq"), ("ChIP-seq", "ChIPseq"), ("CUT&Tag", "CUT and Tag", "CUTandTag"), ("Hi-C", "HiC"),
    ("Stereo-seq", "stereoseq"), ("Visium", "10x Visium", "spatial transcriptomics (Visium)"), ("MERFISH",),
    ("spatial transcriptomics", "空间转录组", "ST"), ("whole-genome sequencing", "WGS", "全基因组测序"),
    ("proteomics", "mass spectrometry proteomics", "蛋白质组"), ("DNA methylation", "bisulfite sequencing", "WGBS", "甲基化"))


def modality_names(spark) -> DataFrame:
    """(norm, name): fifteen names and their synonyms; a fixed, small table."""
    rows = [(alias, names[0]) for names in MODALITIES for alias in names]
    return spark.createDataFrame(rows, "alias string, name string").select(norm(F.col("alias")).alias("norm"), "name").dropDuplicates(["norm"])


def check_ids(docs: DataFrame, accessions: DataFrame, repos: DataFrame) -> DataFrame:
    """(eid, item, status) for every accession and repository a document names: bad_format, unanchored,
    verified, not_found or unverified. accessions(accession, found), repos(repo, found) are registries."""
    acc = docs.select("eid", F.explode("doc.assets.datasets").alias("d")).select("eid", F.trim("d.accession").alias("item"), F.col("d.database").alias("db")).filter("item is not null")
    a = acc.join(accessions.select(F.col("accession").alias("item"), "found"), "item", "left")
    astat = F.when(~ids.accession_ok(F.col("item"), F.col("db")), "bad_format").when(F.col("found"), "verified").when(~F.col("found"), "not_found").otherwise("unverified")
    rep = docs.select("eid", F.explode("doc.assets.methods").alias("m")).select("eid", F.trim("m.repo").alias("url")).filter("url is not null").withColumn("repo", ids.repo(F.col("url")))
    r = rep.join(repos.select("repo", "found"), "repo", "left")
    rstat = (F.when(F.col("repo").isNull(), F.when(F.col("url").rlike("^https?://"), "unanchored").otherwise("bad_format"))
             .when(F.col("found"), "verified").when(~F.col("found"), "not_found").otherwise("unverified"))
    return (a.select("eid", "item", astat.alias("status")).unionByName(r.select("eid", F.coalesce("repo", "url").alias("item"), rstat.alias("status")))).distinct()


def suspects(checks: DataFrame) -> DataFrame:
    return checks.filter(F.col("status").isin("bad_format", "not_found")).select("eid", "item").distinct()


def check_taxa(docs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(name, taxon_id): every organism name the documents use, once; null when the table lacks it."""
    own = docs.select(F.explode("doc.paper.organisms").alias("name"))
    data = docs.select(F.explode("doc.assets.datasets").alias("d")).select(F.col("d.organism").alias("name")).filter("name is not null")
    return own.unionByName(data).distinct().join(taxonomy, "name", "left").select("name", "taxon_id")


def papers(docs: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(eid, key, doi, title, year): exports of one paper share a key. They are joined by metadata id, by DOI or by equal
    title in the same or the next year; an unknown year joins any. A paper is named by its metadata id, else by its DOI,
    else by its title. metadata(eid, metadata_id)."""
    known = docs.sparkSession.createDataFrame([], "eid long, metadata_id string") if metadata is None else metadata
    known = known.filter("metadata_id is not null").groupBy("eid").agg(F.min("metadata_id").alias("metadata_id"))
    p = docs.select("eid", ids.doi(F.col("doc.paper.doi")).alias("doi"), F.col("doc.paper.title").alias("title"), F.col("doc.paper.year").alias("year"))
    p = p.withColumn("t", F.lower(F.trim("title"))).withColumn("node", F.concat_ws("|", F.lit("t"), "t", F.coalesce(F.col("year").cast("string"), F.lit("?"))))
    p = p.join(known, "eid", "left")
    ty = p.select("t", "year", "node").distinct()
    nxt = ty.filter("year is not null").select("t", (F.col("year") - 1).alias("year"), F.col("node").alias("b"))
    first = ty.filter("year is not null").groupBy("t").agg(F.min_by("node", "year").alias("b"))
    pairs = (p.filter("doi is not null").select(F.concat(F.lit("d|"), "doi").alias("a"), F.col("node").alias("b"))
             .unionByName(p.filter("metadata_id is not null").select(F.concat(F.lit("m|"), "metadata_id").alias("a"), F.col("node").alias("b")))
             .unionByName(ty.join(nxt, ["t", "year"]).select(F.col("node").alias("a"), "b"))
             .unionByName(ty.filter("year is null").join(first, "t").select(F.col("node").alias("a"), "b"))).distinct()
    nodes = p.select(F.col("node").alias("key")).unionByName(pairs.select(F.col("a").alias("key"))).distinct()
    c = components(nodes, pairs)
    g = p.join(c.withColumnRenamed("key", "node"), "node")
    lead = g.groupBy("component").agg(F.min(F.struct("eid", "doi", "title")).alias("f"), F.min_by("metadata_id", F.when(F.col("metadata_id").isNotNull(), F.col("eid"))).alias("mid"))
    key = work_key(F.col("mid"), F.col("f.doi"), norm(F.col("f.title")))
    return cut(g.join(lead.select("component", key.alias("key")), "component").select("eid", "key", "doi", "title", "year"))


PARENTS = 1 << 20  # places kept for the parents of one method in a position


def _seq(kind: int, pos: str = "pos") -> Column:
    """The order of appearance: document, kind, position. Positions past the last place share it; they are no ids."""
    at = F.col(pos) if kind != 5 else F.expr(f"{pos} div {PARENTS}") * 64 + F.least(F.col(pos) % PARENTS, F.lit(63))
    return F.col("eid") * (1 << 20) + kind * (1 << 16) + F.least(at, F.lit((1 << 16) - 1))


def _attrs(**cols: Column) -> Column:
    both = [x for k, c in cols.items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*both), lambda k, v: v.isNotNull() & (v != ""))


def _items(docs: DataFrame, path: str) -> DataFrame:
    return docs.select("eid", F.posexplode(f"doc.{path}").alias("pos", "x"))


def mentions(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Every named thing of every document; bad(eid, item): ids that may not be stored."""
    none, arr = F.lit(None).cast("string"), F.array().cast("array<string>")

    def rows(df: DataFrame, kind: int, etype: str, name: Column, attrs: Column, aliases: Column = arr, origin: Column = none, local: Column | None = None,
             anchor: Column = none, auto: bool = True, pos: str = "pos") -> DataFrame:
        return df.select(F.concat_ws(".", "eid", F.lit(kind), pos).alias("mid"), "eid", F.lit(etype).alias("type"), name.alias("name"), aliases.alias("aliases"),
                         origin.alias("origin"), (F.col("x.id") if local is None else local).alias("local_id"), anchor.alias("anchor"), F.lit(auto).alias("auto"),
                         _seq(kind, pos).alias("seq"), attrs.alias("attrs"))

    nothing = F.expr(NO_MAP)
    topic = rows(_items(docs, "topics"), 1, "topic", F.col("x.name"), nothing, F.coalesce("x.aliases", arr))
    claim = rows(_items(docs, "claims"), 2, "claim", F.col("x.text"), nothing, auto=False)
    out = bad.select(F.col("eid").alias("_e"), F.col("item").alias("_bad"), F.lit(True).alias("gone"))
    d = _items(docs, "assets.datasets").join(out, (F.trim("x.accession") == F.col("_bad")) & (F.col("eid") == F.col("_e")), "left").filter("gone is null")
    raw, db = F.trim("x.accession"), ids.effective_database(F.trim("x.accession"), F.col("x.database"))
    acc = F.when(raw.isNotNull(), F.when(db == "Zenodo", F.concat(F.lit("zenodo."), ids.zenodo(raw))).otherwise(raw))
    dataset = rows(d, 3, "dataset", F.coalesce("x.name", acc), _attrs(accession=acc, database=db, name=F.col("x.name"), organism=F.col("x.organism"), tissue=F.col("x.tissue"),
                   modality=F.col("x.modality"), scale=F.col("x.scale"), public=F.col("x.public")), F.filter(F.array(acc), lambda a: a.isNotNull()), anchor=F.concat(F.lit("dataset:"), acc))
    repo, bt = ids.repo(F.col("x.repo")), ids.biotools(F.col("x.biotools"))
    m = _items(docs, "assets.methods").withColumn("repo", repo).join(
        out, (F.coalesce("repo", "x.repo") == F.col("_bad")) & (F.col("eid") == F.col("_e")), "left")
    good = F.when(F.col("gone").isNull(), F.col("repo"))
    link = F.when(F.col("gone").isNull(), F.coalesce("repo", F.col("x.repo")))
    method = rows(m, 4, "method", F.col("x.name"), _attrs(io=F.col("x.io"), modality=F.col("x.modality"), repo=link, biotools=bt, maintained=F.col("x.maintained")),
                  F.filter(F.array(good, F.concat(F.lit("biotools:"), bt)), lambda a: a.isNotNull()), anchor=F.concat(F.lit("method:repo:"), good))
    parents = _items(docs, "assets.methods").select("eid", F.col("pos").alias("mpos"), F.posexplode("x.extends").alias("j", "parent")).withColumn("pos", F.col("mpos").cast("long") * PARENTS + F.col("j"))
    extended = rows(parents.withColumn("x", F.struct(F.lit(None).cast("string").alias("id"))), 5, "method", F.col("parent"), nothing)
    tr = F.col("x.transfer")
    idea = rows(_items(docs, "assets.ideas"), 6, "idea", F.col("x.text"), _attrs(origin=F.col("x.origin"), transfer_type=tr["type"], transfer_to=tr["to"], transfer_barrier=tr["barrier"]), origin=F.col("x.origin"))
    insight = rows(_items(docs, "user_insights"), 7, "idea", F.col("x.text"), _attrs(origin=F.lit("user"), weight=F.lit("2.0")), origin=F.lit("user"))
    allof = topic
    for df in (claim, dataset, method, extended, idea, insight):
        allof = allof.unionByName(df)
    return allof


class Graph:
    """The derived tables of documents. Each is made when it is first asked for and kept, so who needs the papers alone
    resolves no mention, and who needs the edges alone makes no entities or cards."""

    def __init__(self, docs: DataFrame, accessions: DataFrame, repos: DataFrame, taxonomy: DataFrame, metadata: DataFrame | None, th: Thresholds, **scoring):
        self.docs, self.taxonomy, self.metadata, self.th, self._scoring = stored(docs, "documents"), taxonomy, metadata, th, scoring
        self.checks = check_ids(self.docs, accessions, repos)

    @cached_property
    def paper(self) -> DataFrame:
        return papers(self.docs, self.metadata)

    @property
    def paper_of(self) -> DataFrame:
        """eid -> work key."""
        return self.paper.select("eid", "key")

    @cached_property
    def mentions(self) -> DataFrame:
        return stored(mentions(self.docs, suspects(self.checks)), "mentions")

    def resolved(self, *types: str) -> Resolved:
        """The mentions resolved, those of ``types`` alone if any are given: groups, neighbours and acronyms never go across types."""
        ment = self.mentions.filter(F.col("type").isin(*types)) if types else self.mentions
        probe = ment.withColumn("text", F.coalesce(entity_text(F.col("type"), F.col("name"), F.col("attrs")), F.col("name")))
        return resolve(probe.select("mid", "type", "name", "aliases", "origin", "text", "anchor", "auto", "seq"), th=self.th, **self._scoring)

    @cached_property
    def resolution(self) -> Resolved:
        return self.resolved()

    @cached_property
    def at(self) -> DataFrame:
        """The mentions with the key each was given."""
        return stored(self.mentions.join(self.resolution.assigned, "mid").select(*self.mentions.columns, "key"), "placed")

    @cached_property
    def statements(self) -> DataFrame:
        return stored(_statements(self.docs, self.paper, self.at, self.taxonomy), "statements")

    @cached_property
    def _folded(self) -> tuple[DataFrame, DataFrame]:
        return _edges(self.statements)

    @property
    def edge(self) -> DataFrame:
        return self._folded[0]

    @property
    def records(self) -> DataFrame:
        """Earlier evidence of an edge."""
        return self._folded[1]

    @cached_property
    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return _entities(self.docs, self.paper, self.at, self.resolution, self.statements, self.taxonomy, self.checks, self.th, self.edge)

    @property
    def entity(self) -> DataFrame:
        """key, type, canonical_name, external_id, status, origin, attrs, created_at."""
        return self._tables[0]

    @property
    def alias(self) -> DataFrame:
        return self._tables[1]

    @property
    def work(self) -> DataFrame:
        """entity_key, year, tier."""
        return self._tables[2]

    @property
    def hubs(self) -> DataFrame:
        """The organism and modality entities; what a mention of an asset says of them does not wait for the asset's key."""
        own = self.docs.select("eid", F.lit(None).cast("string").alias("src"), "doc.paper.organisms", "doc.paper.modalities")
        named = self.mentions.filter("type in ('dataset','method')").filter((norm(F.col("name")) != "") | F.col("anchor").isNotNull())
        return hub_entities(_hub_rows(own, named.withColumn("src", F.lit(None).cast("string")), self.taxonomy))

    @cached_property
    def cards(self) -> DataFrame:
        return _cards(self.docs, self.paper, self.at, self.entity)

    @cached_property
    def queue(self) -> DataFrame:
        return _queue(self.resolution.queue, self.at, self.paper, self.docs, self.th)

    @property
    def memo(self) -> DataFrame | None:
        """New verdicts of a pair classifier."""
        return self.resolution.memo


def materialize(docs: DataFrame, accessions: DataFrame | None = None, repos: DataFrame | None = None, taxonomy: DataFrame | None = None, apart: DataFrame | None = None,
                pinned: DataFrame | None = None, th: Thresholds = Thresholds(), metadata: DataFrame | None = None, rerank: Reranker | None = None,
                nli: Judge | None = None, memo: DataFrame | None = None) -> Graph:
    """docs(eid, doc, tier, created_at) -> the derived tables. Registries and the taxonomy are tables too; scorers of pairs
    are arguments, their new verdicts come back with the graph."""
    spark = docs.sparkSession
    accessions = accessions if accessions is not None else spark.createDataFrame([], "accession string, found boolean")
    repos = repos if repos is not None else spark.createDataFrame([], "repo string, found boolean")
    taxonomy = taxonomy if taxonomy is not None else spark.createDataFrame([], "name string, taxon_id string")
    return Graph(docs, accessions, repos, taxonomy, metadata, th, apart=apart, pinned=pinned, rerank=rerank, nli=nli, memo=memo)


def _place(df: DataFrame, at: DataFrame, kind: int) -> DataFrame:
    """(eid, pos, x) items with the key their mention was given."""
    keys = at.select("mid", "key")
    return df.withColumn("mid", F.concat_ws(".", "eid", F.lit(kind), "pos")).join(keys, "mid")


def local_ids(at: DataFrame) -> DataFrame:
    """(eid, local_id, key, type): the first item that declares an id owns it."""
    return at.filter("local_id is not null").groupBy("eid", "local_id").agg(F.min_by(F.struct("key", "type"), "seq").alias("m")).select("eid", "local_id", "m.*")


def references(refs: DataFrame, at: DataFrame) -> DataFrame:
    """refs(eid, ref, ...) with the key meant: a local id where the file uses ids, else a name, by type."""
    loc = local_ids(at)
    uses = loc.select("eid").distinct().withColumn("by_id", F.lit(True))
    order = F.create_map(*[x for i, t in enumerate(("topic", "method", "dataset", "idea", "claim")) for x in (F.lit(t), F.lit(i))])
    names = at.select(norm(F.col("name")).alias("n"), "key", order[F.col("type")].alias("prio"), F.col("seq").alias("id"))
    r = refs.select("ref").distinct()
    byname = first_match(r, "ref", r.withColumn("n", norm(F.col("ref"))).join(names, "n").select("ref", "prio", "id", F.col("key").alias("found"))).select("ref", F.col("found").alias("nkey"))
    out = refs.join(uses, "eid", "left").join(loc.select("eid", F.col("local_id").alias("ref"), F.col("key").alias("ikey")), ["eid", "ref"], "left").join(byname, "ref", "left")
    return out.withColumn("target", F.when(F.col("by_id"), F.col("ikey")).otherwise(F.col("nkey"))).drop("ikey", "nkey")


def _hub_key(etype: str, name: Column, fixed: Column) -> Column:
    return F.when(fixed.isNotNull(), F.concat(F.lit("organism:taxon:" if etype == "organism" else "modality:"), fixed)).otherwise(F.concat(F.lit(f"{etype}:"), norm(name)))


def hub_rows(docs: DataFrame, paper: DataFrame, at: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(src, dst, type, eid, name): organism and modality links of papers and assets."""
    own = docs.select("eid", "doc.paper.organisms", "doc.paper.modalities").join(paper.select("eid", F.col("key").alias("src")), "eid")
    return _hub_rows(own, at.filter("type in ('dataset','method')").withColumn("src", F.col("key")), taxonomy)


def _hub_rows(own: DataFrame, keyed: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """own(eid, src, organisms, modalities) and keyed(eid, src, attrs) as links to hubs."""
    rows = own.select("eid", "src", F.explode("organisms").alias("name"), F.lit("organism").alias("t")).unionByName(
        own.select("eid", "src", F.explode("modalities").alias("name"), F.lit("modality").alias("t")))
    rows = rows.unionByName(keyed.select("eid", "src", F.col("attrs")["organism"].alias("name"), F.lit("organism").alias("t"))).unionByName(
        keyed.select("eid", "src", F.col("attrs")["modality"].alias("name"), F.lit("modality").alias("t"))).filter("name is not null")
    voc = F.broadcast(modality_names(own.sparkSession).select(F.col("norm").alias("vn"), F.col("name").alias("vname")))  # fixed size
    tax = taxonomy.select(F.col("name").alias("tn"), "taxon_id")
    r = rows.withColumn("n", norm(F.col("name"))).join(voc, F.col("n") == F.col("vn"), "left").join(tax, F.col("name") == F.col("tn"), "left")
    dst = F.when(F.col("t") == "organism", _hub_key("organism", F.col("name"), F.col("taxon_id"))).otherwise(_hub_key("modality", F.col("name"), F.lower("vname")))
    shown = F.when(F.col("t") == "modality", F.coalesce("vname", F.trim("name"))).otherwise(F.trim("name"))
    return r.select("src", dst.alias("dst"), F.concat(F.lit("of_"), "t").alias("type"), "eid", shown.alias("name"), F.trim("name").alias("alias"))


def hub_entities(hubs: DataFrame) -> DataFrame:
    """One row per hub, named by the first document; eid is that document."""
    return hubs.groupBy(F.col("dst").alias("key")).agg(F.min_by("name", F.struct("eid", "name")).alias("canonical_name"), F.substring_index(F.first("type"), "_", -1).alias("type"), F.min("eid").alias("eid")).select(
        "key", "type", "canonical_name", F.when(F.col("key").startswith("organism:taxon:"), F.expr("substring(key, 10)")).alias("external_id"), F.lit(None).cast("string").alias("origin"), F.expr(NO_MAP).alias("attrs"), "eid")


def _statements(docs: DataFrame, paper: DataFrame, at: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(src, dst, type, eid, confidence, evidence, attrs, seq): one row per statement of an edge."""
    pk = paper.select("eid", F.col("key").alias("work"))
    nothing, none = F.expr(NO_MAP), F.lit(None).cast("string")

    def st(df: DataFrame, src: Column, dst: Column, etype: Column, kind: int, conf: Column = F.lit(1.0), ev: Column = none, attrs: Column = nothing, pos: str = "pos") -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), etype.alias("type"), "eid", conf.alias("confidence"), ev.alias("evidence"), attrs.alias("attrs"), _seq(kind, pos).alias("seq"))

    w, k = F.col("work"), F.col("key")
    hubs = hub_rows(docs, paper, at, taxonomy).withColumn("pos", F.lit(0))
    out = st(hubs, F.col("src"), F.col("dst"), F.col("type"), 0)
    topic = _place(_items(docs, "topics"), at, 1).join(pk, "eid")
    out = out.unionByName(st(topic, w, k, F.col("x.relation"), 1))
    claim = _place(_items(docs, "claims"), at, 2).join(pk, "eid")
    ca = _attrs(evidence_type=F.col("x.evidence_type"), boundary=F.col("x.boundary"), logic_jump=F.col("x.logic_jump"), strength=strength(F.col("x.evidence_type"), F.col("x.logic_jump")))
    out = out.unionByName(st(claim, w, k, F.col("x.stance"), 2, F.when(F.col("x.logic_jump"), 0.5).otherwise(1.0), F.col("x.evidence"), ca))
    for kind, path in ((3, "assets.datasets"), (4, "assets.methods")):
        a = _place(_items(docs, path), at, kind).join(pk, "eid")
        out = out.unionByName(st(a, w, k, F.col("x.role"), kind, ev=F.col("x.evidence")))
    par = _place(_items(docs, "assets.methods"), at, 4).select("eid", F.col("pos").alias("mpos"), F.col("key").alias("child"), F.posexplode("x.extends").alias("j", "p")).withColumn("pos", F.col("mpos").cast("long") * PARENTS + F.col("j"))
    out = out.unionByName(st(_place(par, at, 5), F.col("child"), k, F.lit("extends"), 5))
    idea = _place(_items(docs, "assets.ideas"), at, 6).join(pk, "eid")
    out = out.unionByName(st(idea, w, k, F.lit("proposes"), 6, attrs=_attrs(origin=F.col("x.origin"))))
    to = references(idea.filter("x.transfer.to is not null").select("eid", "pos", "key", F.col("x.transfer.to").alias("ref"), F.col("x.transfer.type").alias("tt"), F.col("x.transfer.barrier").alias("tb")), at)
    to = to.join(at.filter("type = 'topic'").select(F.col("key").alias("target")).distinct(), "target", "left_semi")
    out = out.unionByName(st(to, k, F.col("target"), F.lit("applicable_to"), 6, attrs=_attrs(transfer_type=F.col("tt"), barrier=F.col("tb"))))
    ins = _place(_items(docs, "user_insights"), at, 7).join(pk, "eid")
    user = _attrs(origin=F.lit("user"))
    out = out.unionByName(st(ins, w, k, F.lit("proposes"), 7, attrs=user))
    links = insight_links(docs, at).filter("target is not null and target != key")
    etype = F.when(F.col("target").startswith("topic:"), "applicable_to").otherwise("relates_to")
    out = out.unionByName(st(links, k, F.col("target"), etype, 7, attrs=user))
    return out.filter("src != dst")


def insight_links(docs: DataFrame, at: DataFrame) -> DataFrame:
    """(eid, pos, key, ref, target): what each insight links to; target is null when it resolves to nothing."""
    ins = _place(_items(docs, "user_insights"), at, 7).select("eid", "pos", "key", F.explode("x.links_to").alias("ref"))
    return references(ins, at).select("eid", "pos", "key", "ref", "target")


def _edges(stm: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = stm.select("src", "dst", "type", F.col("eid").alias("extraction_id"), "seq", "confidence", "evidence", F.lit(0).alias("rank"))
    last = stm.groupBy("src", "dst", "type").agg(F.max_by("attrs", F.struct("eid", F.size("attrs"), "seq")).alias("attrs"))
    e = ru.fold_statements(s).join(last, ["src", "dst", "type"]).drop("rank").withColumn("status", F.lit("auto"))
    return cut(e), ru.evidence_records(s)


def _entities(docs, paper, at, res, stm, taxonomy, checks, th, edge) -> tuple[DataFrame, DataFrame, DataFrame]:
    when = docs.select("eid", "created_at", F.coalesce("tier", F.lit(1)).alias("tier"))
    made = at.select("key", "eid").unionByName(paper.select("key", "eid")).join(when, "eid").groupBy("key").agg(F.min("created_at").alias("created_at"))
    roles = stm.filter("type in ('produces','proposes')").select(F.col("dst").alias("key"), "eid").distinct().withColumn("producer", F.lit(True))
    vals = (at.join(roles, ["key", "eid"], "left").select("key", "type", "seq", F.coalesce("producer", F.lit(False)).alias("producer"), F.explode("attrs").alias("attr", "value"))
            .withColumn("normed", norm(F.col("value"))))
    anchored = vals.filter("type in ('dataset','method')")
    kept = ru.reported(anchored).select("key", "attr", "value").unionByName(ru.filled(vals.filter("type not in ('dataset','method')")))
    mine = at.filter("origin = 'user'").select("key").distinct().select("key", F.lit("user").alias("mine"))
    ok = checks.filter("status = 'verified'").select(F.col("item").alias("ext")).distinct().withColumn("verified", F.lit("verified"))
    attrs = kept.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("attrs"))  # at most the known attributes
    free = res.entities.withColumn("ext", F.regexp_replace("anchor", "^(dataset|method:repo|method):", "")).join(mine, "key", "left").join(ok, "ext", "left")
    assets = free.join(attrs, "key", "left").select(
        "key", "type", "canonical_name", F.col("ext").alias("external_id"), F.coalesce("mine", "origin").alias("origin"),
        F.map_concat(F.coalesce("attrs", F.expr(NO_MAP)), F.when(F.col("ext").isNotNull(), F.create_map(F.lit("verified"), F.coalesce("verified", F.lit("unverified")))).otherwise(F.expr(NO_MAP))).alias("attrs"))
    d = docs.select("eid", F.col("doc.depth").alias("depth"), F.array_join("doc.tldr", "\n").alias("tldr"), F.col("doc.paper.venue").alias("venue"),
                    F.array_join("doc.paper.authors", "\n").alias("authors"), F.col("doc.language").alias("language"),
                    ids.unwrap_link(F.col("doc.paper.url")).alias("url")).join(paper, "eid").join(when, "eid")
    rank = F.struct((F.col("depth") == "deep").cast("int").alias("deep"), "eid")

    def best(c: str) -> Column:
        return F.max_by(c, F.when(F.length(c) > 0, rank))

    wk = d.groupBy("key").agg(F.min_by("title", "eid").alias("canonical_name"), F.min_by("doi", F.when(F.col("doi").isNotNull(), F.col("eid"))).alias("external_id"),
                              F.min_by("year", F.when(F.col("year").isNotNull(), F.col("eid"))).alias("year"), F.max("tier").alias("tier"),
                              F.max(F.when(F.col("depth") == "deep", "deep").otherwise("a")).alias("dd"), best("tldr").alias("tldr"), best("venue").alias("venue"), best("authors").alias("authors"), best("url").alias("url"), best("language").alias("language"))
    works = wk.select("key", F.lit("work").alias("type"), "canonical_name", "external_id", F.lit(None).cast("string").alias("origin"),
                      _attrs(tldr=F.col("tldr"), venue=F.col("venue"), authors=F.col("authors"), url=F.col("url"), language=F.col("language"), depth=F.when(F.col("dd") == "deep", "deep").otherwise("light")).alias("attrs"))
    hubs = hub_rows(docs, paper, at, taxonomy)
    he = hub_entities(hubs)
    hmade = he.join(when, "eid").select("key", "created_at")
    allof = assets.unionByName(works).unionByName(he.drop("eid")).join(made.unionByName(hmade), "key", "left")
    wkeys = paper.select(F.col("key").alias("src")).distinct()
    up = edge.filter("type in ('about','applicable_to')").join(wkeys, "src", "left_semi").groupBy(F.col("dst").alias("key")).agg(F.countDistinct("src").alias("papers"))
    status = F.when((F.col("type") == "topic") & (F.coalesce("papers", F.lit(0)) < th.topic_promote_works), "candidate").otherwise("active")
    entity = cut(allof.join(up, "key", "left").withColumn("status", status).drop("papers"))
    lang = docs.select("eid", alias_language(F.col("doc.language")).alias("declared"))
    al_lang = at.select("key", "eid", "seq").join(lang, "eid").groupBy(F.col("key").alias("entity_key")).agg(F.min_by("declared", "seq").alias("declared"))
    names = (res.aliases.unionByName(_named(paper.select(F.col("key").alias("entity_key"), F.col("title").alias("alias"), F.lit("extraction").alias("source"))))
             .unionByName(_named(paper.filter("doi is not null").select(F.col("key").alias("entity_key"), F.col("doi").alias("alias"), F.lit("doi").alias("source"))))
             .unionByName(_named(hubs.select(F.col("dst").alias("entity_key"), "alias", F.lit("extraction").alias("source")))))
    alias = names.groupBy("entity_key", "norm").agg(F.min("alias").alias("alias"), F.min("source").alias("source")).join(al_lang, "entity_key", "left")
    alias = alias.withColumn("lang", F.when(has_han(F.col("alias")), "zh").otherwise(F.coalesce("declared", F.lit("en")))).drop("declared")
    return entity, cut(alias), wk.select(F.col("key").alias("entity_key"), "year", "tier")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", norm(F.col("alias"))).filter(F.length("norm").between(1, 500)).select("entity_key", "norm", "alias", "source")


def template_card(etype: Column, name: Column, external_id: Column, attrs: Column, title: Column, origin: Column, links: Column) -> Column:
    """struct(q, a) for an asset without a written card; null when there is no cue beyond the title."""
    facts = F.concat_ws(" / ", attrs["organism"], attrs["modality"], attrs["tissue"])
    dataset = F.when(external_id.isNotNull() & (facts != ""), F.struct(F.concat(F.lit("What is in dataset "), external_id, F.lit("?")).alias("q"), facts.alias("a")))
    method = F.when(attrs["io"].isNotNull(), F.struct(F.concat(F.lit("Which method does "), attrs["io"], F.lit(" ("), title, F.lit(")?")).alias("q"), name.alias("a")))
    cue = (F.when(attrs["transfer_to"].isNotNull(), F.concat(F.lit("Which idea of "), title, F.lit(" carries over to "), attrs["transfer_to"], F.lit("?")))
           .when(links.isNotNull(), F.concat(F.lit("Which idea links "), links, F.lit("?")))
           .when(origin == "user", F.concat(F.lit("What was your own idea about "), title, F.lit("?"))))
    idea = F.when(cue.isNotNull(), F.struct(cue.alias("q"), name.alias("a")))
    return F.when(etype == "dataset", dataset).when(etype == "method", method).when(etype == "idea", idea)


def _cards(docs: DataFrame, paper: DataFrame, at: DataFrame, entity: DataFrame) -> DataFrame:
    """Written cards of deep documents, then a template for each of their uncovered assets."""
    deep = docs.filter("doc.depth = 'deep'").join(paper.select("eid", F.col("key").alias("work"), "title"), "eid")
    wr = deep.select("eid", "work", F.explode("doc.review_cards").alias("c")).select("eid", "work", "c.q", "c.a", F.trim("c.about").alias("ref"))
    held = references(wr, at)
    dropped = F.col("by_id") & F.col("ref").isNotNull() & F.col("target").isNull()
    user = entity.filter("origin = 'user'").select("key", F.lit(True).alias("mine"))
    written = held.filter(~F.coalesce(dropped, F.lit(False))).select(F.coalesce("target", "work").alias("key"), "eid", "q", "a", F.lit("export").alias("origin"))
    mine = at.filter("type != 'claim'").select("eid", "key").distinct().join(deep.select("eid", "title"), "eid")
    un = mine.join(written.select("eid", "key"), ["eid", "key"], "left_anti").join(
        entity.select("key", "type", "canonical_name", "external_id", "attrs", F.col("origin").alias("whose")), "key")
    names = entity.select(F.col("key").alias("target"), F.substring("canonical_name", 1, 80).alias("shown"))
    linked = top_per(insight_links(docs, at).select("key", "target").distinct().join(names, "target").filter("key != target"), ["key"], [F.col("shown"), F.col("target")], 3)
    linked = linked.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("shown")), " ↔ ").alias("linked"))  # at most three names
    un = un.join(linked, "key", "left")
    tpl = un.withColumn("c", template_card(F.col("type"), F.col("canonical_name"), F.col("external_id"), F.col("attrs"), F.col("title"), F.col("whose"), F.col("linked"))).filter("c is not null").select("key", "eid", "c.q", "c.a", F.lit("template").alias("origin"))
    allof = written.unionByName(tpl).join(user, "key", "left")
    cid = card_id(F.col("key"), F.col("q"), F.col("origin"))
    return cut(allof.groupBy(cid.alias("id")).agg(F.max_by(F.struct(F.col("key").alias("entity_key"), "q", "a", "origin"), F.struct("eid", "q", "a")).alias("m"),
                                             F.max(F.when(F.col("mine"), 10).otherwise(0)).alias("priority")).select("id", "m.*", "priority"))


def _queue(q: DataFrame, at: DataFrame, paper: DataFrame, docs: DataFrame, th: Thresholds) -> DataFrame:
    """Questions for the user; a contradiction names the paper whose claim raised it."""
    pk = paper.select("eid", F.col("key").alias("work"))
    who = at.filter("type = 'claim'").select(F.col("key").alias("a"), "eid").join(pk, "eid").groupBy("a").agg(F.min_by("work", "eid").alias("work"))
    out = q.join(who, "a", "left")
    dk = F.when(F.col("kind") == "contradiction", F.concat(F.lit("contradiction:"), "work", F.lit("|"), "b")).otherwise(F.col("dedupe_key"))
    return cut(out.withColumn("dedupe_key", dk).groupBy("dedupe_key").agg(F.max_by(F.struct("kind", "a", "b", "work", "score"), F.struct("score", "a")).alias("m")).select("dedupe_key", "m.*").withColumn("status", F.lit("pending")))


def summary(docs: DataFrame, known: DataFrame, graph: Graph, before: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per document: whether its bytes were known, the entities it brought, suspect ids, and how
    many exports its paper already had. docs(eid, sha256), known(sha256), before(key): entities of the library."""
    dup = docs.select("eid", "sha256").join(known.select("sha256", F.lit(True).alias("dup")).distinct(), "sha256", "left")
    srcs = graph.paper_of.select("eid", F.col("key").alias("work"))
    new = (graph.edge.select(F.col("src").alias("work"), F.col("dst").alias("key")).join(srcs.select("work").distinct(), "work", "left_semi").join(before.select("key"), "key", "left_anti")
           .groupBy("work").agg(F.countDistinct("key").alias("new_entities")))
    bad = suspects(checks).groupBy("eid").agg(F.count("*").alias("suspects"))
    exports = srcs.groupBy("work").agg(F.count("*").alias("exports"))
    return (dup.join(srcs, "eid").join(new, "work", "left").join(bad, "eid", "left").join(exports, "work").select(
        "eid", "work", F.coalesce("dup", F.lit(False)).alias("duplicate"), F.coalesce("new_entities", F.lit(0)).alias("new_entities"), F.coalesce("suspects", F.lit(0)).alias("suspects"), "exports"))
