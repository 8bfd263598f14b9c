"""Decontamination, near-duplicates, repeated passages and URL verdicts against plain Python."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import prose

from marginalia.llm import components, decontaminate, near_dedup, queries, suffix_dedup, url_filter
from marginalia.llm import text as t

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_words(text, kind):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if kind is t.ALPHANUMERIC else r"[^\x20\x09-\x0D]+"
    return re.findall(pattern, (text or "").translate(LOWER))


@pytest.mark.parametrize("kind", [t.ALPHANUMERIC, t.NOT_BLANK])
def test_words(kind):
    texts = ["A b", "", None, "x", "äÖ-9z ", "a\x85b\u2003c\x1fd", "end"]
    found = t.words(pa.array(texts), kind)
    got = [[found.word(i) for i in range(found.first[d], found.first[d + 1])] for d in range(len(texts))]
    assert got == [as_words(x, kind) for x in texts]
    again = t.words(pa.array(["zz end x"]), kind)
    assert set(again.hash.tolist()) & set(found.hash.tolist()) == {found.hash[-1], found.hash[found.first[3]]}


def contaminated(documents, items, window=13):
    windows = {}
    for item, text in items:
        w = as_words(text, t.ALPHANUMERIC)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for doc, text in documents:
        w, hit, found = as_words(text, t.ALPHANUMERIC), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 40])
def test_contamination(spark, odd_documents, block):
    base = prose(1, 120).split()
    items = [
        (1, " ".join(base[10:40])), (2, "Two WORDS"), (3, None), (4, ""), (5, "aaaa " * 13), (6, " ".join(base[20:33])),
        (7, prose(9, 40)), (8, "日本語"), (8, "日本語"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(odd_documents, table, block=block)
    got = Counter(map(tuple, queries.decontamination_columns(found).collect()))
    assert got == contaminated(rows_of(odd_documents), items)


def test_contamination_of_nothing(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert decontaminate.contamination(no_documents, items).count() == 0
    clean = decontaminate.contamination(odd_documents, items.limit(0)).collect()
    assert len(clean) == odd_documents.count() and all(r["n_hit"] == 0 and not r["items"] for r in clean)


def classes(documents, k, similarity=80):
    sets = []
    for doc, text in documents:
        w = as_words(text, t.NOT_BLANK)
        sets.append({tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(documents)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= similarity * len(a | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(documents):
        if doc is not None:
            ids[root(i)] = min(doc, ids.get(root(i), doc))
    return Counter((d, len(s), ids.get(root(i))) for i, ((d, _), s) in enumerate(zip(documents, sets)))


def test_near_duplicates_of_odd_rows(odd_documents, no_documents):
    found = near_dedup.near_duplicates(odd_documents, words=4).collect()
    got = Counter((r["doc"], r["n_shingles"], r["component"]) for r in found)
    assert got == classes(rows_of(odd_documents), 4)
    assert all(r["kept"] == (r["doc"] == r["component"] or r["component"] is None) for r in found)
    assert near_dedup.near_duplicates(no_documents).count() == 0


def changed(words, share, draw):
    return [w if draw.random() > share else f"x{draw.integers(1e6)}" for w in words]


def test_near_duplicates_of_a_group_around_the_limit(spark):
    """Copies with few and many changes: links, chains and pairs just below the limit in one bucket."""
    draw, base = np.random.default_rng(3), prose(7, 200).split()
    rows = [(i, " ".join(changed(base, share, draw))) for i, share in enumerate(draw.uniform(0.002, 0.06, 90).tolist())]
    rows += [(1000 + i, prose(50 + i, 40)) for i in range(10)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(documents, words=4).collect()
    assert Counter((r["doc"], r["n_shingles"], r["component"]) for r in found) == classes(rows, 4)


def test_sketches_estimate_similarity():
    a = t.mix(np.arange(1000, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:800], t.mix(np.arange(5000, 5200, dtype=np.uint64))]))
    few = a[:2]
    hashes, first = np.concatenate([np.sort(a), b, few]), np.array([0, 1000, 2000, 2002])
    sketch = near_dedup.sketches(hashes, first)
    assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 800 / 1200) < 0.2


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 101), (7, 7)]
    found = components.components(spark.createDataFrame(links, "u long, v long"))
    assert dict(map(tuple, found.collect())) == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def without_repeats(documents, length):
    seen, out = set(), {}
    for doc, text in sorted(documents, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        if (doc, data) in out:
            continue
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        edges = [p for p in range(len(data) + 1) if (gone[p] if p < len(data) else 0) != (gone[p - 1] if p else 0)]
        out[doc, data] = (list(zip(edges[::2], edges[1::2])), bytes(c for c, g in zip(data, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeated_spans(odd_documents, hot):
    documents = odd_documents.filter("doc_id IS NOT NULL")
    expected = without_repeats(rows_of(documents), 100)
    found = suffix_dedup.repeated_spans(documents, hot=hot).collect()
    assert len(found) == documents.count()
    texts = dict(rows_of(documents))
    for r in found:
        spans, kept = expected[r["doc"], (texts[r["doc"]] or "").encode()]
        assert ([tuple(s) for s in r["spans"]], bytes(r["kept"])) == (spans, kept), r["doc"]
        assert r["row"]["key"] == 9


def test_repeated_spans_of_shared_lines(spark):
    """One line between ever different neighbours, shorter and longer than the limit."""
    lines = [prose(77, 12)[:n] for n in (60, 97, 100, 140)]
    rows = [(i, f"{prose(200 + i, 30)} {lines[i % 4]} {prose(300 + i, 30)}é") for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    expected = without_repeats(rows, 100)
    for hot in (suffix_dedup.HOT, 3):
        found = suffix_dedup.repeated_spans(documents, hot=hot, as_text=True).collect()
        assert {r["doc"]: [tuple(s) for s in r["spans"]] for r in found} == {d: v[0] for (d, _), v in expected.items()}
    assert suffix_dedup.repeated_spans(documents.limit(0)).count() == 0


def test_one_id_for_several_texts(spark):
    a, b, c = prose(501, 60), prose(502, 60), prose(503, 60)
    rows = [(1, a), (1, b), (1, b), (2, a + c), (None, c), (None, b + "x"), (None, c)]
    found = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc"], r["n_bytes"], bytes(r["kept"])) for r in found}
    assert len(found) == 7
    size = lambda x: len(x.encode())
    first = {(1, size(a), a.encode()), (1, size(b), b.encode())}
    assert first < got and (None, size(c), b"") in got and (None, size(b) + 1, b"x") in got
    (two,) = [r for r in found if r["doc"] == 2]
    assert bytes(two["kept"]).endswith(c.encode()) and len(two["kept"]) <= size(c) + 1


def test_characters_go_as_a_whole(spark):
    rows = [(1, "é" * 49 + "ab"), (2, "xx" + "é" * 49 + "ab" + "zz"), (3, "€" * 60)]
    found = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).collect()
    assert {r["doc"]: r["kept"] for r in found} == {1: rows[0][1], 2: "xxzz", 3: "€"}


def test_loser_tree_merges_runs():
    draw = np.random.default_rng(1)
    runs, everything = [], []
    for _ in range(5):
        keys = sorted({bytes(draw.integers(97, 99, draw.integers(1, 12)).astype(np.uint8)) + b"\xff" for _ in range(30)})
        everything += keys
        shared, rest = suffix_dedup.front_coded(keys)
        sizes = np.array([len(k) for k in keys], dtype=np.uint8)
        zeros = np.zeros(len(keys))
        runs.append(suffix_dedup.Run(shared.tobytes(), sizes.tobytes(), rest, zeros.astype(np.int32).tobytes(), b"", b""))
    got = [(key, shared) for key, shared, _, _ in suffix_dedup.merged(runs)]
    assert [k for k, _ in got] == sorted(everything)
    for (a, _), (b, shared) in zip(got, got[1:]):
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared == n


def plain_rule(host, path, rules):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.Example.NET/en/x?q#f", "ftp://x.net", "http://x.net/", "http://example.com/de/1",
        "http://myexample.com/de/", "http://org/fr/", "http://a.org/fr", "http://b.ORG/fr/ü#/en/", "x://y://z.net/", "http://h?a/b", "HTTP://q\n.net/a\nb",
    ]
    rules = url_filter.parsed_rules(queries.URL_RULES)
    rows = [(i, u, "x", "y") for i, u in enumerate(urls + urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score string")
    found = {r["page"]: r for r in url_filter.judge(pages, rules).collect()}
    assert len(found) == len(rows)
    for i, u, *_ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        rule, verdict = plain_rule(host, path, rules)
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    unlabelled = url_filter.judge(pages, []).collect()
    assert all(r["verdict"] == "allow" and r["score"] == 0 for r in unlabelled)


def test_url_model_tells_rejected_hosts(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'evil'}{i % 17}.{'net' if i % 3 else 'org'}/{i}") for i in range(300)]
    rules = [("block", f"evil{i}.net", "/") for i in range(17)] + [("allow", f"good{i}.net", "/") for i in range(17)]
    found = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    free = [r for r in found if r["rule"] is None]
    assert len(free) == 100
    assert all((r["verdict"] == "allow") == ("good" in r["host"]) for r in free)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cursor = db.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cursor.fetchall())


def test_suffix_query(spark, sf):
    documents = rows_of(spark.read.parquet(f"{sf}/documents.parquet"))
    expected = {d: (len(x), sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for (d, x), (s, k) in without_repeats(documents, 100).items()}
    assert {r[0]: tuple(r[1:]) for r in queries.QUERIES["op7_suffix_dedup"](spark, sf).collect()} == expected
