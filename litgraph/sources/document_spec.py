"""The export document: one declaration of its fields, read both as the Spark schema and as the rules
a document is checked by."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION_KEY = "rxf_version"  # fixed value: the key every export of this format carries
VERSIONS = (1,)

# Field names, allowed values and required fields (!) of format version 1.
# name | name:int | name:bool | name:text (number or flag kept as text) | name=a/b | name[] | name:struct | name[struct]
SPEC = {
    "document": f"{VERSION_KEY}:int! id exported_at language instructions_version:text prompt_version depth=light/deep "
                "paper:paper! tldr[] topics[topic] claims[claim] assets:assets issues[issue] user_insights[insight] review_cards[card]",
    "paper": "doi title! year:int type[]=research/tool/resource/benchmark/review/protocol organisms[] modalities[] authors[] venue url",
    "topic": "id name! relation!=about/applicable_to aliases[]",
    "claim": "id text! evidence_type!=causal/correlational/speculative evidence! boundary logic_jump:bool stance=supports/contradicts",
    "assets": "datasets[dataset] methods[method] ideas[idea]",
    "dataset": "id accession database=GEO/SRA/ENA/GSA/CNGB/ArrayExpress/Zenodo/other name organism tissue modality scale:text "
               "public:text role=uses/produces evidence",
    "method": "id name! repo biotools role=proposes/uses/evaluates io maintained:text modality extends[] evidence",
    "idea": "id text! transfer:transfer origin=model/user",
    "transfer": "type!=cross-species/cross-modality/cross-problem to barrier",
    "issue": "id severity!=minor/major/critical location text! test",
    "insight": "id text! links_to[]",
    "card": "id q! a! about",
}
DEFAULTS = {("document", "depth"): "light", ("claim", "stance"): "supports", ("claim", "logic_jump"): False, ("dataset", "role"): "uses",
            ("method", "role"): "uses", ("idea", "origin"): "model"}
# The lists whose elements may declare an id, and what such an element is.
ID_HOLDERS = {"topics": "topic", "claims": "claim", "assets.datasets": "dataset", "assets.methods": "method", "assets.ideas": "idea",
              "issues": "issue", "user_insights": "user_insight", "review_cards": "review_card"}
NODE_KINDS = ("topic", "claim", "dataset", "method", "idea", "user_insight")
MAX_TLDR = 5


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # str, int, bool, text, or a struct name
    many: bool
    required: bool
    allowed: tuple[str, ...]


def _field(token: str) -> Field:
    m = re.fullmatch(r"(\w+)(?:\[(\w*)\])?(?::(\w+))?(!?)(?:=(\S+))?", token)
    name, item, kind, bang, allowed = m.groups()
    return Field(name, (item or kind or "str"), item is not None, bool(bang), tuple(allowed.split("/")) if allowed else ())


FIELDS = {struct: tuple(_field(t) for t in line.split()) for struct, line in SPEC.items()}
BY_NAME = {struct: {f.name: f for f in fields} for struct, fields in FIELDS.items()}
SCALARS = {"str": T.StringType(), "text": T.StringType(), "int": T.IntegerType(), "bool": T.BooleanType()}


def spark_type(struct: str = "document") -> T.StructType:
    def of(f: Field) -> T.DataType:
        base = SCALARS.get(f.kind) or spark_type(f.kind)
        return T.ArrayType(base) if f.many else base
    return T.StructType([T.StructField(f.name, of(f)) for f in FIELDS[struct]])


def check(value: dict, struct: str = "document", path: str = "") -> list[tuple]:
    """Problems as (path, kind, field, value): one per cause."""
    fields = BY_NAME[struct]
    here = path or "(root)"
    out = [(here, "unexpected_field", k, None) for k in value if k not in fields]
    for f in FIELDS[struct]:
        if f.name not in value:
            if f.required:
                out.append((here, "missing_field", f.name, ", ".join(f.allowed) or None))
            continue
        v, where = value[f.name], f"{path}.{f.name}" if path else f.name
        if f.many:
            if not isinstance(v, list):
                out.append((where, "bad_type", f.name, "array"))
                continue
            for i, item in enumerate(v):
                out += _check_one(item, f, f"{where}.{i}", in_list=True)
        elif v is not None or f.required:
            out += _check_one(v, f, where, in_list=False)
    return out


def _check_one(v, f: Field, where: str, in_list: bool) -> list[tuple]:
    if f.kind in FIELDS:
        if isinstance(v, dict):
            return check(v, f.kind, where)
        need = [x.name for x in FIELDS[f.kind] if x.required]
        return [(where, "bad_type", f.name, "object" + (f" with {', '.join(need)}" if in_list and need else ""))]
    ok = {"str": isinstance(v, str), "text": isinstance(v, (str, int, float)), "bool": isinstance(v, bool),
          "int": isinstance(v, int) and not isinstance(v, bool)}[f.kind]
    if f.allowed and v not in f.allowed:
        return [(where, "bad_value", f.name, ", ".join(f.allowed))]
    if not ok:
        return [(where, "bad_type", f.name, {"str": "string", "int": "integer", "bool": "boolean", "text": "string"}[f.kind])]
    if f.name == "year" and not 1600 <= v <= 2100:
        return [(where, "other", f.name, "1600 to 2100")]
    return []


def late_checks(doc: dict) -> list[tuple]:
    """Rules over several fields; looked at only when every field is right."""
    out = []
    if len(doc.get("tldr") or []) > MAX_TLDR:
        out.append(("tldr", "other", "tldr", f"at most {MAX_TLDR}"))
    for i, d in enumerate(((doc.get("assets") or {}).get("datasets")) or []):
        if not (d.get("accession") or d.get("name")):
            out.append((f"assets.datasets.{i}", "other", None, "needs an accession or a name"))
    return out


def normalised(value: dict, struct: str = "document") -> dict:
    """A valid document with defaults filled, text stripped and number-or-text fields as text."""
    out = {}
    for f in FIELDS[struct]:
        v = value.get(f.name)
        if f.many:
            out[f.name] = [_plain(x, f) for x in (v or [])]
        elif f.kind in FIELDS:
            out[f.name] = normalised(v, f.kind) if isinstance(v, dict) else (normalised({}, f.kind) if f.kind == "assets" else None)
        else:
            out[f.name] = DEFAULTS.get((struct, f.name)) if v is None else _plain(v, f)
    return out


def _plain(v, f: Field):
    if f.kind in FIELDS:
        return normalised(v, f.kind)
    if isinstance(v, str):
        return v.strip()
    if f.kind == "text":
        return str(v).lower() if isinstance(v, bool) else str(v)
    return v


def _items(doc: Column, path: str) -> Column:
    """The elements of a list in a document, as (value, position); none where there is no list."""
    values = F.coalesce(F.try_variant_get(doc, "$." + path, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("at")))


def _said(item: Column, field: str) -> Column:
    """A field of an element as trimmed text; null if it is missing or blank."""
    return F.nullif(F.trim(F.try_variant_get(item["value"], "$." + field, "string")), F.lit(""))


def declared(doc: Column) -> tuple[Column, Column]:
    """Of a document as a variant: (path, kind, id) of every element that declares an id, and (path, id) of every
    reference, by an insight's links and a card's subject."""
    def holders(path: str, kind: str) -> Column:
        rows = F.transform(_items(doc, path), lambda x: F.struct(
            F.concat(F.lit(f"{path}."), x["at"].cast("string"), F.lit(".id")).alias("path"), F.lit(kind).alias("kind"), _said(x, "id").alias("id")))
        return F.filter(rows, lambda x: x["id"].isNotNull())

    ids = F.concat(*[holders(path, kind) for path, kind in ID_HOLDERS.items()])
    links = F.flatten(F.transform(_items(doc, "user_insights"), lambda x: F.transform(
        F.coalesce(F.try_variant_get(x["value"], "$.links_to", "array<string>"), F.array().cast("array<string>")),
        lambda to, j: F.struct(F.concat(F.lit("user_insights."), x["at"].cast("string"), F.lit(".links_to."), j.cast("string")).alias("path"), F.trim(to).alias("id")))))
    about = F.transform(_items(doc, "review_cards"), lambda x: F.struct(
        F.concat(F.lit("review_cards."), x["at"].cast("string"), F.lit(".about")).alias("path"), F.trim(F.try_variant_get(x["value"], "$.about", "string")).alias("id")))
    return ids, F.filter(F.concat(links, about), lambda r: r["id"].isNotNull())


# Drift of early exports: a transfer written beside the idea instead of inside it, and a flag that topics no longer have.
STRAY_TRANSFER = {"transfer_type": "type", "type": "type", "transfer_to": "to", "to": "to", "transfer_barrier": "barrier", "barrier": "barrier"}


def _mappings(doc: dict, *path: str) -> list[dict]:
    """The mappings in the list at ``path``."""
    for name in path:
        doc = doc.get(name) if isinstance(doc, dict) else None
    return [x for x in doc if isinstance(x, dict)] if isinstance(doc, list) else []


def repaired(doc: dict) -> list[str]:
    """Fixes known drift in place; the codes of what changed."""
    done = {"transfer_flattened": False, "topic_new_flag": False}
    for idea in _mappings(doc, "assets", "ideas"):
        stray = {name: idea.pop(name) for name in STRAY_TRANSFER if name in idea}
        given = idea.get("transfer")
        if stray or isinstance(given, str):
            whole = {"type": given} if isinstance(given, str) else dict(given or {}) if isinstance(given, dict) or given is None else {}
            for name, value in stray.items():
                whole.setdefault(STRAY_TRANSFER[name], value)
            idea["transfer"] = whole
            done["transfer_flattened"] = True
    for topic in _mappings(doc, "topics"):
        if "new" in topic:
            topic.pop("new")
            done["topic_new_flag"] = True
    return [code for code, changed in done.items() if changed]
