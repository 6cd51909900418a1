"""The replay by joins against the same log replayed decision by decision."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from litgraph.functions.text import norm_text
from litgraph.model import Library
from litgraph.operators import replay

AT = dt.datetime(2024, 1, 1)
RANK = {"auto": 0, "confirmed": 1, "rejected": 2}
KEYS = [f"topic:t{i}" for i in range(7)] + [f"idea:i{i}" for i in range(4)] + [f"work:w{i}" for i in range(3)]


def start():
    status = {k: "candidate" if k.endswith(("1", "4")) else "active" for k in KEYS}
    origin = {k: "user" if k == "idea:i2" else None for k in KEYS}
    rnd = random.Random(1)
    edges = {}
    for _ in range(26):
        a, b = rnd.sample(KEYS, 2)
        edges[a, b, rnd.choice(["about", "is_a"])] = rnd.choice(["auto", "auto", "confirmed", "rejected"])
    return status, origin, edges


def key_of(kind, name):
    n = norm_text(name)
    return f"{kind}:{hashlib.sha256(n.encode()).hexdigest()[:20] if kind in ('idea', 'claim') else n}"


class Sequential:
    """One decision after the other."""

    def __init__(self):
        self.status, self.origin, self.edges = start()
        self.name = {k: k.split(":")[1] for k in self.status}
        self.alias = {(k, n) for k, n in self.name.items()}
        self.into, self.skipped = {}, []

    def at(self, key):
        while key in self.into:
            key = self.into[key]
        return key if key in self.status else None

    def named(self, kind, name):
        return min((self.at(k) for k, n in self.base_alias if n == norm_text(name) and k.split(":")[0] == kind), default=None)

    def set(self, src, dst, kind, status):
        if src is None or dst is None or src == dst:
            return
        if status == "confirmed" or (src, dst, kind) in self.edges:
            self.edges[src, dst, kind] = status

    def rekey(self, old, new, only=None):
        for (s, d, t), status in list(self.edges.items()):
            if (only is None and old in (s, d)) or (only is not None and (s, d, t) in only):
                del self.edges[s, d, t]
                s2, d2 = (new if x == old else x for x in (s, d))
                if s2 != d2:
                    self.edges[s2, d2, t] = max(status, self.edges.get((s2, d2, t), "auto"), key=RANK.get)

    def run(self, log):
        self.base_alias = set(self.alias)
        for i, op, p in log:
            getattr(self, op)(i, p)

    def merge(self, i, p):
        f, t = p["from"], p["into"]
        if f in self.into:
            return
        if self.at(f) is None or self.at(t) is None:
            return self.skipped.append((i, "not found"))
        if f == t or f.split(":")[0] != t.split(":")[0]:
            return self.skipped.append((i, "same entity" if f == t else "different types"))
        t = self.at(t)
        if t == f:
            return
        self.into[f] = t
        self.rekey(f, t)
        self.alias = {(t if k == f else k, n) for k, n in self.alias}
        if self.status[f] == "active" and self.status[t] == "candidate":
            self.status[t] = "active"
        for d in (self.status, self.name, self.origin):
            d.pop(f)

    def _key(self, i, p):
        k = self.at(p["key"])
        if k is None:
            self.skipped.append((i, "not found"))
        return k

    def rename(self, i, p):
        if k := self._key(i, p):
            self.name[k] = p["name"]
            self.alias.add((k, norm_text(p["name"])))

    def add_alias(self, i, p):
        if k := self._key(i, p):
            self.alias.add((k, norm_text(p["alias"])))

    def confirm_topic(self, i, p):
        if k := self._key(i, p):
            self.status[k] = "active"

    def reject_entity(self, i, p):
        if k := self._key(i, p):
            if k.startswith("work:"):
                return self.skipped.append((i, "a paper is retracted, not rejected"))
            self.status[k] = "rejected"

    def edge_status(self, i, p):
        self.set(self.at(p["src"]), self.at(p["dst"]), p["type"], p["status"])

    def add_edge(self, i, p):
        self.set(self.at(p["src"]), self.at(p["dst"]), p["type"], "confirmed")

    def _new(self, kind, name, i):
        key = key_of(kind, name)
        if key in self.into or key in self.status:
            return self.at(key), False
        if (k := self.named(kind, name)) is not None:
            return k, False
        self.status[key], self.origin[key], self.name[key] = "active", "user" if kind == "idea" else None, name
        self.alias.add((key, norm_text(name)))
        return key, True

    def create_topic(self, i, p):
        k, _ = self._new("topic", p["name"], i)
        self.status[k] = "active"
        if p.get("parent"):
            self.set(k, self.at(p["parent"]), "is_a", "confirmed")

    def create_idea(self, i, p):
        k, _ = self._new("idea", p["text"], i)
        for x in p["links"]:
            x = self.at(x)
            if x:
                self.set(k, x, "applicable_to" if x.startswith("topic:") else "relates_to", "confirmed")

    def split(self, i, p):
        k = self.at(p["key"])
        if k is None:
            return
        sigs = {(self.at(e["src"]), self.at(e["dst"]), e["type"]) for e in p["edges"]}
        hit = {e for e in sigs if e in self.edges and k in e[:2]}
        if not hit:
            return
        new = key_of(k.split(":")[0], p["new_name"])
        if new not in self.status:
            self.status[new], self.name[new], self.origin[new] = "active", p["new_name"], None
            self.alias.add((new, norm_text(p["new_name"])))
        self.rekey(k, new, hit)


def random_log(seed):
    rnd, log = random.Random(seed), []
    _, _, edges = start()
    for i in range(45):
        op = rnd.choice(["merge", "merge", "edge_status", "edge_status", "edge_status", "add_edge", "rename", "add_alias", "confirm_topic", "reject_entity", "create_topic", "create_idea", "split"])
        key = rnd.choice(KEYS + ["topic:none", "topic:made 1"])
        s, d, t = rnd.choice(sorted(edges)) if rnd.random() < 0.7 else (*rnd.sample(KEYS, 2), "about")
        p = {"merge": {"from": key, "into": rnd.choice([k for k in KEYS if k[:3] == key[:3]] + KEYS[:1])}, "edge_status": {"src": s, "dst": d, "type": t, "status": rnd.choice(["confirmed", "rejected", "auto"])},
             "add_edge": {"src": s, "dst": d, "type": t}, "rename": {"key": key, "name": f"name {i}"}, "add_alias": {"key": key, "alias": f"alias {i}"}, "confirm_topic": {"key": key}, "reject_entity": {"key": key},
             "create_topic": {"name": rnd.choice(["Made 1", "t5", f"Made {i}"]), "parent": rnd.choice(KEYS[:7])}, "create_idea": {"text": f"thought {i}", "links": rnd.sample(KEYS, 2)},
             "split": {"key": rnd.choice([s, d]), "new_name": f"part {i}", "edges": [{"src": s, "dst": d, "type": t}]}}[op]
        log.append((i + 1, op, p))
    return log


def library(spark):
    status, origin, edges = start()
    e = spark.createDataFrame([(i, k, k.split(":")[0], k.split(":")[1], s, origin[k], AT) for i, (k, s) in enumerate(status.items())],
                              "id long, key string, type string, canonical_name string, status string, origin string, created_at timestamp")
    d = spark.createDataFrame([(a, b, t, s, 0.5, None, AT) for (a, b, t), s in edges.items()],
                              "src string, dst string, type string, status string, confidence double, evidence string, created_at timestamp")
    a = spark.createDataFrame([(k, k.split(":")[1], k.split(":")[1], "name") for k in status], "entity_key string, alias string, norm string, source string")
    return Library(entity=e, edge=d, alias=a, work=spark.createDataFrame([(k, 2020, 1) for k in status if k.startswith("work:")], "entity_key string, year int, tier int"))


def table(spark, log):
    return spark.createDataFrame([(i, op, json.dumps(p)) for i, op, p in log], "id long, op string, payload string").withColumn(
        "created_at", F.expr("timestamp '2024-02-01 00:00:00'")).withColumn("revoked_at", F.lit(None).cast("timestamp"))


@pytest.mark.parametrize("seed", range(2))
def test_random_logs(spark, seed):
    log = random_log(seed)
    want = Sequential()
    want.run(log)
    out, skipped = replay.apply_all(library(spark), table(spark, log))
    got = {(r["src"], r["dst"], r["type"]): r["status"] for r in out.edge.collect()}
    assert got == want.edges
    assert {r["key"]: r["status"] for r in out.entity.collect()} == want.status
    assert {(r["entity_key"], r["norm"]) for r in out.alias.collect()} >= want.alias
    names = {r["key"]: r["canonical_name"] for r in out.entity.collect()}
    assert {k: n for k, n in names.items() if k != "idea:i2" and want.origin.get(k) != "user" and names[k] != "i2"} == {
        k: n for k, n in want.name.items() if k != "idea:i2" and want.origin.get(k) != "user" and names[k] != "i2"}
    assert {(r["id"], r["reason"]) for r in skipped.collect()} == set(want.skipped)


def test_status_before_a_merge_is_of_the_edge_of_that_time(spark):
    lib = library(spark)
    at = lambda a, b, s: (a, b, "cites", s, 0.5, None, AT)
    lib = lib.with_(edge=spark.createDataFrame([at("work:w0", "topic:t0", "auto"), at("work:w0", "topic:t2", "confirmed"), at("work:w1", "topic:t0", "auto")], lib.edge.schema))
    log = [(1, "edge_status", {"src": "work:w0", "dst": "topic:t0", "type": "cites", "status": "rejected"}), (2, "merge", {"from": "topic:t0", "into": "topic:t2"}),
           (3, "edge_status", {"src": "work:w1", "dst": "topic:t0", "type": "cites", "status": "confirmed"}), (4, "merge", {"from": "topic:t2", "into": "topic:t0"})]
    out, _ = replay.apply_all(lib, table(spark, log))
    assert {(r["src"], r["dst"]): r["status"] for r in out.edge.collect()} == {("work:w0", "topic:t2"): "rejected", ("work:w1", "topic:t2"): "confirmed"}
    later = log[:2] + [(5, "edge_status", {"src": "work:w0", "dst": "topic:t0", "type": "cites", "status": "auto"})]
    out, _ = replay.apply_all(lib, table(spark, later))
    assert {(r["src"], r["dst"]): r["status"] for r in out.edge.collect()} == {("work:w0", "topic:t2"): "auto", ("work:w1", "topic:t2"): "auto"}


def test_paths_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"k{i:03}", f"k{i + 1:03}", 1000 - i if i % 2 else i + 1) for i in range(40)], "key string, into string, id long")
    path = replay.paths(links).collect()
    for time in (0, 5, 500, 980, 5000):
        for k in (0, 7, 39):
            at = k
            while at < 40 and (1000 - at if at % 2 else at + 1) < time:
                at += 1
            assert [r["at"] for r in path if r["key"] == f"k{k:03}" and r["start"] < time <= r["stop"]] == [f"k{at:03}"]


def test_only_concerned_edges_are_replayed(spark):
    edge = spark.createDataFrame([("a", "x", "about"), ("b", "x", "about"), ("c", "x", "about"), ("d", "m", "about"), ("e", "n", "about"), ("f", "p", "about"), ("g", "q", "about")], "src string, dst string, type string")
    path = spark.createDataFrame([("m", "m", -1, 5), ("m", "n", 5, 9)], "key string, at string, start long, stop long")
    decided = spark.createDataFrame([("a", "y")], "src string, dst string")
    splits = spark.createDataFrame([("p", "q", "f")], "key string, new_key string, src string")
    near, others = replay.concerned(edge, decided, path, splits)
    assert sorted(r["src"] for r in near.collect()) == ["a", "d", "e", "f", "g"]
    assert sorted(r["src"] for r in others.collect()) == ["b", "c"]
