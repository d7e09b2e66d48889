"""Manifest, URL filter and prefix trie: against plain versions, on small tables with awkward rows."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkelt.llm import manifest, prefix_trie, url_filter
from sparkelt.llm.ordered import numbered
from sparkelt.llm.queries import ENTRIES
from tests.conftest import SMALLEST, TABLES, plan


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", ["op11_manifest", "op12_url_filter", "op13_prefix_trie"])
def test_query_equals_its_sql(spark, name):
    run, sql = ENTRIES[name]
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALLEST}/{table}.parquet'")
    df = run(spark, SMALLEST)
    twin = duck.execute(sql)
    names = [d[0] for d in twin.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(map(tuple, df.select(*names).collect())) == ordered(twin.fetchall())


# -- places -----------------------------------------------------------------

def test_places_of_a_hot_group(spark):
    draw = random.Random(3)
    rows = [("a" if k % 3 else f"g{k}", draw.randrange(500), k) for k in range(3000)]
    got = numbered(spark.createDataFrame(rows, "g string, x int, k int"), "g", "x", "k").collect()
    want = []
    for g in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == g)
        want += [(*r, i, len(own)) for i, r in enumerate(own)]
    assert ordered(map(tuple, got)) == ordered(want)


# -- manifest ---------------------------------------------------------------

def plain_manifest(rows, changed):
    """leaf, subroot, root, proof and folded root per row of (doc_id, lang, text), folded without any kept state."""
    def leaf(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for i, g, t in rows:
        groups.setdefault(g, []).append((i, leaf(i, g, t), leaf(i, g, changed(i, t))))
    tops, parts = [], []
    for g in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        level, found = [r[1] for r in own], [[r[2], ""] for r in own]
        step = 1
        while len(level) > 1:
            runs = [level[k:k + 8] for k in range(0, len(level), 8)]
            for k, f in enumerate(found):
                run, slot = runs[k // step // 8], k // step % 8
                f[1] += "".join(run[:slot] + run[slot + 1:])
                f[0] = sha("".join(run[:slot]) + f[0] + "".join(run[slot + 1:]))
            level, step = [sha("".join(run)) for run in runs], step * 8
        tops.append(level[0])
        parts.append((own, found))
    root, out = sha("".join(tops)), []
    for n, (own, found) in enumerate(parts):
        for (i, digest, _), (folded, proof) in zip(own, found):
            last = sha("".join(tops[:n]) + folded + "".join(tops[n + 1:]))
            out.append((i, digest, tops[n], root, proof + "".join(tops[:n] + tops[n + 1:]), last, last == root))
    return ordered(out)


def manifest_rows(big):
    rows = [(k, "en", f"Text {k} É") for k in range(big)] + [(k, "de", None if k % 2 else "") for k in range(9)]
    return [*rows, (7, None, "No Lang"), (None, "en", "no id"), (None, "en", "no id"), (3, "en", "Text 3 É"), (3, "en", "other"), (1, "é", "x"), (1, "z", "x" * 100_000)]


@pytest.mark.parametrize("big", [5, 8, 9, 65, 513, 5000])
def test_manifest_against_a_plain_one(spark, big):
    rows = manifest_rows(big)
    df = spark.createDataFrame([(*r, 0, "q") for r in rows], "doc_id long, lang string, text string, place int, path string")
    change = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    got = manifest.manifest(df, ("doc_id", "lang", "text"), replaced={"text": change})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    want = plain_manifest(rows, lambda i, t: t.lower() if i is not None and i % 3 == 0 and t else t)
    assert ordered(map(tuple, got.collect())) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(1, None, "a")], "doc_id long, lang string, text string")
    row = manifest.manifest(df, ("doc_id", "text")).first()
    assert row["leaf"] == row["subroot"] == sha("1:11:a") and row["root"] == sha(row["leaf"]) == row["folded_root"]
    assert row["proof"] == "" and row["verified"]
    assert manifest.manifest(df.limit(0), ("doc_id", "text")).collect() == []


def test_a_node_folds_by_its_state():
    children = [sha(str(k)).encode() for k in range(8)]
    node = manifest.Node(children)
    for slot in range(8):
        assert node.fold(slot, children[slot]) == node.digest
        assert node.fold(slot, b"x").decode() == sha(b"".join([*children[:slot], b"x", *children[slot + 1:]]).decode())


# -- URL filter -------------------------------------------------------------

URLS = [
    ("https://Blog.Example.ORG/en/1?x#y", "blog.example.org", "/en/1", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://a.example.org/es/#", "a.example.org", "/es/", "example.org/es/", "block"),
    ("http://example.org/es", "example.org", "/es", "org/", "allow"),
    ("ftp://x.com/fr/?q=://b.com/de/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/9\n9", "x.com", "/de/9\n9", "com/de/", "block"),
    ("http://com/de/", "com", "/de/", "com/de/", "block"),
    ("HTTP://ÄB.COM?a/b", "Äb.com", "", None, "allow"),
    ("no scheme/en/1", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"),
    ("http://h.net/" + "/".join(["seg"] * 3000), "h.net", "/" + "/".join(["seg"] * 3000), None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    rows = [(k, u[0], "h", 1) for k, u in enumerate(URLS)] + [(0, URLS[0][0], "h", 1), (None, None, "h", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    got = url_filter.url_verdicts(df).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(k, *u[1:]) for k, u in enumerate(URLS)] + [(0, *URLS[0][1:]), (None, "", "", None, "allow")]
    assert ordered(map(tuple, got)) == ordered(want)
    assert url_filter.url_verdicts(df.limit(0)).collect() == []


def test_templates_merge_like_branches_and_reject_bad_ones(spark):
    rows = []
    for lang in ("en", "fr", "de"):
        rows += [(f"http://a.net/{lang}/{k}", int(k % 20 == 0) if k % 2 else None) for k in range(200)]
    rows += [(f"http://a.net/spam/{k}", 1 if k % 3 else None) for k in range(200)]
    rows += [(f"http://a.net/file/{k}x/report.pdf", 0) for k in range(200)]
    rows += [(f"http://b.net/once/{k}.html", None) for k in range(4)]
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, bad int")
    got = url_filter.url_verdicts(df, bad=F.col("bad"), rules=())
    found = {(r["host"], r["template"], r["verdict"]): r["n"] for r in got.groupBy("host", "template", "verdict").agg(F.count("*").alias("n")).collect()}
    assert found == {("a.net", "/de|en|fr/?n", "allow"): 600, ("a.net", "/spam/?n", "block"): 200, ("a.net", "/file/?a/report.pdf", "allow"): 200, ("b.net", "/?w/?n.html", "allow"): 4}


def test_kinds_of_segments(spark):
    some = {"": "", "12": "?n", "12.html": "?n.html", "1a2B-3c4d": "?h", "ab12x": "?a", "about": "?w", ".git": ".git", "v1.2": "?a", "deadbeef": "?w"}
    df = spark.createDataFrame([(k,) for k in some], "s string")
    assert {r["s"]: r["k"] for r in df.select("s", url_filter.kind(F.col("s")).alias("k")).collect()} == some


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/en/7.html"), (2, "http://a/7/?x=8"), (3, None), (4, "http://a/en/x8"), (5, "http://a/9#7")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, 0, 0), (9, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["bad"] for r in url_filter.labelled_pages(pages, labels).collect()}
    assert got == {1: 1, 2: 1, 3: None, 4: None, 5: 0}


def test_url_verdicts_use_no_python_workers(spark):
    text = plan(ENTRIES["op12_url_filter"][0](spark, SMALLEST))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


# -- prefix trie ------------------------------------------------------------

def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))

    def unit(t):
        return sha(f"{len(t[0].encode())}:{t[0]}{t[1]}")[:32]

    for conv, ts in own.items():
        own[conv] = [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, unit(t[1:])))]
    whole = {}
    for conv, ts in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        whole[conv] = tuple([*own.get(conv - conv % 5, [])[:h], *ts[h:]])
    nodes = {}
    for conv, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(conv)
    children = {n: sum(len(m) == len(n) + 1 and m[:len(n)] == n for m in nodes) for n in nodes}
    out = []
    for n, members in nodes.items():
        under = [m for m in nodes if m[:len(n)] == n]
        out.append((
            min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], sum(not children[m] for m in under),
            sum((len(nodes[m]) - 1) * len(m[-1][1].encode()) for m in under if m), sha(",".join(str(c) for c in sorted(members) if whole[c] == n))))
    return ordered(out)


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")


def conversations(count, seed=1):
    draw, rows = random.Random(seed), []
    for conv in range(count):
        rows += [(conv, k, draw.choice(["user", "assistant", None]), draw.choice(["a", "b", "é", "", None])) for k in range(draw.randrange(1, 7))]
    return rows


AWKWARD = [
    (3, None, "user", "first"), (3, 0, "user", "next"), (3, 0, "user", "next"), (3, 0, "user", "tie"), (None, 0, "user", "nobody"), (10, 0, None, None),
    (12, 0, "x", "y" * 50_000), (11, 0, "ab", "c"), (14, 0, "a", "bc"), (20, 5, "user", "a"), (20, 4, "user", "b"),
]


@pytest.mark.parametrize("rows", [conversations(60), conversations(7, 2), AWKWARD, [(5, 0, "u", "t")], [(6, 0, "u", "t")]])
def test_trie_against_a_plain_one(spark, rows):
    got = prefix_trie.conversation_trie(turns(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert ordered(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_of_one_conversation_that_most_repeat(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = []
    for conv in range(0, 1500):
        words = ["same", "words", "again"] if conv % 3 else ["same", "words", f"own {conv}"]
        rows += [(conv, k, "user", w) for k, w in enumerate(words)]
    assert ordered(map(tuple, prefix_trie.conversation_trie(turns(spark, rows)).collect())) == plain_trie(rows)


def test_trie_of_one_long_conversation(spark):
    rows = [(0, k, "user", f"t{k}") for k in range(3000)] + [(1, 0, "user", "t0"), (2, 0, "user", "t1")]
    got = prefix_trie.conversation_trie(turns(spark, rows)).where("depth = 3000").collect()
    assert len(got) == 1 and got[0]["conv_id"] == 0 and got[0]["n_leaves"] == 1


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.conversation_trie(turns(spark, [])).collect() == []


def test_shared_units():
    draw = random.Random(4)
    for _ in range(500):
        a, b = ("".join(draw.choice(["x", "y"]) * prefix_trie.UNIT for _ in range(draw.randrange(9))) for _ in range(2))
        want = 0
        while want < min(len(a), len(b)) // prefix_trie.UNIT and a[:(want + 1) * prefix_trie.UNIT] == b[:(want + 1) * prefix_trie.UNIT]:
            want += 1
        assert prefix_trie.shared_units(a, b) == want
