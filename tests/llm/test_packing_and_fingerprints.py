"""Token ids, packing, fingerprints and the pipeline against plain Python and exact round trips."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings, strategies as st

import corpus_pipeline
from marginalia.llm import fingerprint, packing, queries
from marginalia.llm.wordids import WordIds
from tests.llm.conftest import prose

PATH = queries.tokenizer_path()
ENCODER = WordIds(PATH)
PIECES = ["'s", "'t", "'re", "'ll", "'", "''", "!'s", "don't", " ", "\n", " ", "é", "é", "Σ", "ΑΣ", "İ", "ß", "12", "½", "日本", "a_b", "<|endoftext|>", "\x00", "\x1c", "X", "word", "😀", "ﬁ", "Å"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join), max_size=4))
@example([":\U00013460", "a\u1c89 e\u0301", "plain"])
def test_ids_equal_the_tokenizers(texts):
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    ids, first = ENCODER.encode(texts)
    got = [ids[first[i] : first[i + 1]].tolist() for i in range(len(texts))]
    assert got == [ENCODER.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_of_code_points_of_all_planes():
    draw = np.random.default_rng(8)
    planes = [draw.integers(p << 16, (p + 1) << 16, 120) for p in range(17)] + [np.arange(0x13460, 0x13480)]
    points = [c for c in np.concatenate(planes).tolist() if not 0xD800 <= c < 0xE000]
    texts = [f":{chr(c)}a{chr(c)}1{chr(c)}" for c in points]
    ids, first = ENCODER.encode(texts)
    got = [ids[first[i] : first[i + 1]].tolist() for i in range(len(texts))]
    assert len(texts) > 1000 and got == [ENCODER.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_after_forgetting(monkeypatch):
    monkeypatch.setattr("marginalia.llm.wordids.KNOWN_WORDS", 10)
    encoder = WordIds(PATH)
    for i in range(4):
        text = prose(i, 50)
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def whole(pieces, texts, limits):
    """Checks pieces against texts; returns the lengths of sequences."""
    expected = Counter()
    for doc, text in texts:
        ids = ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected[doc, tuple(ids)] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence"]].append(p)
    got = Counter()
    for (doc, n), own in by_doc.items():
        starts = defaultdict(list)
        for p in own:
            starts[p["start"]].append(p)
        copies = len(starts[0])
        for _ in range(copies):  # equal documents of one id are told apart by any chain
            ids = []
            while len(ids) < n:
                ids += starts[len(ids)].pop()["ids"]
            got[doc, tuple(ids)] += 1
    assert got == expected
    lengths = []
    for own in by_sequence.values():
        end = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == end and p["length"] == len(p["ids"]) > 0
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], dtype="<u4").tobytes())
            end += p["length"]
        assert len(own) <= limits.segments
        lengths.append(end)
    return lengths


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 40)])
def test_packing(odd_documents, no_documents, limits):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    pieces = packing.pack(odd_documents, PATH, limits=limits, with_ids=True).collect()
    lengths = whole(pieces, rows, limits)
    assert all(n == limits.tokens or n & (n - 1) == 0 for n in lengths) and max(lengths) <= limits.tokens
    assert packing.pack(no_documents, PATH).count() == 0


def test_loss_limit(spark):
    rows = [(i, prose(i, 30), 10 * (i % 4)) for i in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, prompt int").repartition(2)
    limits = packing.Limits(256, 8, 200)
    pieces = packing.pack(documents, PATH, loss_from_col="prompt", limits=limits, with_ids=True).collect()
    whole(pieces, [r[:2] for r in rows], limits)
    loss = Counter()
    for p in pieces:
        loss[p["sequence"]] += max(0, p["start"] + p["length"] - max(p["start"], rows[p["doc"]][2]))
    assert max(loss.values()) <= limits.loss


def test_packing_query_pads_little(spark):
    rows = queries.QUERIES["op8_packing"](spark, "/root/testdata/sf0.01").collect()
    length = Counter()
    for r in rows:
        length[r["sequence_id"]] += r["length"]
    assert all(n == 4096 or n & (n - 1) == 0 for n in length.values())
    assert list(length.values()).count(4096) >= 0.9 * len(length)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé😀", max_size=60), st.text(alphabet="abé😀", max_size=60), st.data())
def test_spans_and_extensions(a, b, data):
    p, q = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
    i = data.draw(st.integers(0, len(a)))
    j = data.draw(st.integers(0, len(b)))
    k = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert (p.span(i, i + k) == q.span(j, j + k)) == (a[i : i + k] == b[j : j + k])
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert p.common_extension(i, q, j) == n
    assert (p.fingerprint() == q.fingerprint()) == (a == b)
    assert 0 <= fingerprint.likeness(p.fingerprint(), q.fingerprint()) <= 1


def test_likeness_follows_shared_text():
    text = prose(1, 600)
    own = fingerprint.PrefixHash(text).fingerprint()
    like = lambda x: fingerprint.likeness(own, fingerprint.PrefixHash(x).fingerprint())
    assert like(text) == 1.0 > like(text[:-30] + prose(2, 5)) > 0.75
    assert like(text[:1500] + "X" + text[1500:]) > 0.75
    assert like(prose(3, 600)) < 0.1 and like("") == 0.0


@pytest.mark.parametrize("range_bytes", [fingerprint.RANGE_BYTES, 4000])
def test_successors(odd_documents, no_documents, range_bytes):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, (r[1] or "").encode()))
    expected = Counter()
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [fingerprint.PrefixHash(x).fingerprint() for x in (text, edited, after)]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        near = [round(fingerprint.likeness(prints[0], x), 9) for x in prints[1:]]
        expected[doc, len(text), digest, prints[0], prints[1], *near] += 1
    found = fingerprint.fingerprints(odd_documents, range_bytes=range_bytes).collect()
    got = Counter(
        (r["doc"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9))
        for r in found
    )
    assert got == expected
    assert fingerprint.fingerprints(no_documents).count() == 0


def test_pipeline(spark):
    """Stage by stage on a table of which the right result is known."""
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    english = [r["text"] for r in docs.filter("lang = 'en' AND n_chars > 1500").orderBy("doc_id").limit(8).collect()]
    passage = english[7][:900]
    extra = [
        (900001, None), (900002, ""), (900003, "12 34"), (900004, english[0]), (900005, english[0] + " the end"),
        (900006, items[0]), (900007, passage + " " + english[1][::-1][:300]), (900008, english[2][::-1]),
    ]
    more = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in extra], docs.schema)
    state = docs.unionByName(more)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, state, sf), "test")
        assert after.dtypes == docs.dtypes
        kept.append({r["doc_id"]: r["text"] for r in after.collect()})
        state = after
    language, copies, repeats, clean = kept
    assert not {900001, 900002, 900003} & set(language) and {900004, 900005, 900006, 900007} <= set(language)
    assert len(language) >= docs.count()
    assert not {900004, 900005} & set(copies) and {900006, 900007, 900008} <= set(copies)
    assert set(repeats) == set(copies) and len(repeats[900007]) < 500 and repeats[900008] == extra[7][1]
    assert 900006 not in clean and 900008 in clean
    final = corpus_pipeline.STAGES[-1][1](spark, state, sf).collect()
    assert {r["doc_id"] for r in final} == set(clean)
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_without_rows(spark, sf):
    nothing = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


def test_pipeline_links_documents_by_five_words(spark, sf):
    """One changed word of 44: similarity 37/45 on runs of four words, 35/45 on five."""
    words = [f"word{i}" for i in range(44)]
    other = [*words[:22], "changed", *words[23:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words))], "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2]
