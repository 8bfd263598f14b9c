"""Language identification, toxicity, language-model scores and license scan: odd rows, accuracy, round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import language_id, license_scan, lm_score, queries, toxicity
from marginalia.llm import text as t
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"
TEXTS = {"xx": "aba abo abi abe ", "yy": "zuz zoz zaz zez "}


def test_language_of_odd_rows(spark, odd_documents, no_documents):
    labelled = [(i, TEXTS[k] * 30, k) for i in range(20) for k in TEXTS] + [(99, None, "xx"), (98, "ab", None)]
    net = language_id.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    assert net.languages == ("xx", "yy")
    found = language_id.identify(odd_documents, net).collect()
    assert len(found) == odd_documents.count()
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["language"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["row"]["score"] == "s"
        if not letters:
            assert r["score"] == 0
    own = spark.createDataFrame([(k, v * n) for k, v in TEXTS.items() for n in (1, 3, 400)], "lang string, text string")
    assert all(r["row"]["lang"] == r["language"] and r["score"] > 0.9 for r in language_id.identify(own, net).collect())
    assert language_id.identify(no_documents, net).count() == 0


def test_rare_language_is_learnt(spark):
    """A language with a share far below that of the sample is in it all the same."""
    names = "doc_id long, text string, lang string"
    rows = [(i, TEXTS["xx"] * 5 + str(i), "xx") for i in range(9_000)] + [(9_000 + i, TEXTS["yy"] * 5, "yy") for i in range(2)]
    net = language_id.fit(spark.createDataFrame(rows, names), sample=20)
    assert net.languages == ("xx", "yy")
    own = spark.createDataFrame([(k, v * 3) for k, v in TEXTS.items()], "lang string, text string")
    assert all(r["row"]["lang"] == r["language"] for r in language_id.identify(own, net).collect())


def test_language_without_labels(spark, odd_documents):
    assert language_id.fit(odd_documents.withColumn("lang", odd_documents["text"]).limit(0)) is None
    assert {r["language"] for r in language_id.identify(odd_documents, None).collect()} == {"und"}


def test_windows_cover_whole_texts():
    texts = ["", "x" * 700, "y", "z" * 256]
    data, offsets = t.flat(pa.array(texts))
    windows, of = language_id.cut_windows(data, offsets)
    assert of.tolist() == [1, 1, 1, 2, 3]
    back = [b"".join(windows[of == i].tobytes().rstrip(b"\0") for _ in [0]) for i in range(4)]
    assert [b.replace(b"\0", b"") for b in back] == [x.encode() for x in texts]


def test_convolution_gradients():
    draw = np.random.default_rng(0)
    net = language_id.new_network(("a", "b", "c"))
    net = language_id.Network(*[p.astype(float) if isinstance(p, np.ndarray) else tuple(x.astype(float) for x in p) for p in net[:5]], net.languages)
    windows, truth = draw.integers(1, 50, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        return -language_id.window_scores(net, windows)[np.arange(5), truth].mean()

    for part, gradient in zip(net.parts(), language_id._gradients(net, windows, truth)):
        place = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        part[place] += 1e-5
        up = loss()
        part[place] -= 2e-5
        down = loss()
        part[place] += 1e-5
        assert abs((up - down) / 2e-5 - gradient[place]) < 1e-4


def test_language_query_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_language_id"](spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95


def test_toxicity_query(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = ([s for y, s in held if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.75


def test_misspellings_share_subwords(spark):
    draw = np.random.default_rng(4)
    bad = ["horrible", "dreadful", "abysmal"]
    texts = [prose(i, 60) for i in range(240)]
    toxic = np.arange(240) % 2
    texts = [f"{x[:150]} {draw.choice(bad)} {x[150:]}" if y else x for x, y in zip(texts, toxic)]
    value, shift = toxicity.train(texts, toxic).collapsed()
    score = lambda words: toxicity.text_logits(t.words(pa.array([f"{prose(900 + i, 25)} {w} {prose(950 + i, 25)}" for i, w in enumerate(words)]), t.ALPHANUMERIC), value, shift)
    assert (score(["horrible", "horrrible", "horible", "dreadfull", "abysmall"]) > 0).all()
    assert (score([prose(990 + i, 1) for i in range(8)]) < 0).mean() > 0.8


def test_toxicity_of_odd_rows(spark, odd_documents, no_documents):
    labelled = [(i, prose(i, 20) + (" awful" if i % 2 else ""), i % 2) for i in range(60)] + [(99, None, 1), (98, "", 0), (97, "x", None)]
    labelled = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    texts, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic")
    model = toxicity.fit(texts, labels)
    found = toxicity.toxicity(odd_documents, model).collect()
    assert len(found) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.toxicity(no_documents, model).count() == 0
    assert toxicity.fit(texts, labels.filter("toxic = 0")) is None
    assert toxicity.fit(no_documents, labels) is None
    assert {r["score"] for r in toxicity.toxicity(odd_documents, None).collect()} == {0.0}


def plain_scores(texts, known, parameters):
    embedding, hidden, hidden_shift, of_sets, set_shift, of_classes, shift = lm_score.unpacked(parameters)

    def log_share(z, i):
        return z[i] - np.log(np.exp(z - z.max()).sum()) - z.max()

    out = []
    for text in texts:
        h = t.words(pa.array([text], pa.string()), t.ALPHANUMERIC).hash
        ids, (truth, within), total = known.inputs(h), known.outputs(h), 0.0
        for i in range(len(h)):
            around = [ids[j] if 0 <= j < len(h) else lm_score.EDGE for j in (i - 2, i - 1, i + 1, i + 2)]
            r = np.maximum(np.concatenate([embedding[a] for a in around]) @ hidden + hidden_shift, 0)
            k, own = divmod(int(truth[i]), lm_score.SET_SIZE)
            total += log_share(r @ of_sets + set_shift, k) + log_share(r @ of_classes[k] + shift[k], own) + within[i]
        out.append(total)
    return out


def test_lm_scores(spark, odd_documents, no_documents):
    found = lm_score.score(odd_documents, rounds=1, one_in=2).collect()
    assert len(found) == odd_documents.count()
    for r in found:
        assert r["log_likelihood"] <= 0 and (r["n_words"] > 0 or r["log_likelihood"] == r["mean_log_likelihood"] == 0)
    assert lm_score.score(no_documents).count() == 0
    assert all(r["n_words"] == 0 for r in lm_score.score(odd_documents.filter("doc_id IN (5, 6, 7)")).collect())


def test_lm_training_beats_frequencies(spark):
    """Words come in fixed pairs: the neighbours tell the word, its frequency does not."""
    draw = np.random.default_rng(2)
    names = [prose(i, 1) + str(i) for i in range(60)]
    texts = [" ".join(f"{names[2 * k]} {names[2 * k + 1]}" for k in draw.integers(0, 30, 120)) for _ in range(250)]
    table = spark.createDataFrame([(x,) for x in texts], "text string").repartition(2)
    lm_score.ship(spark)
    known = lm_score.vocabulary(table)
    assert known.class_counts.sum() == sum(len(x.split()) for x in texts)
    parameters = lm_score.train(table, known, rounds=3, one_in=2)
    first = plain_scores(texts[:5], known, lm_score.first_parameters(known))
    last = plain_scores(texts[:5], known, parameters)
    assert sum(last) > 0.75 * sum(first)
    shared = type("Shared", (), {"value": (known, parameters)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([*texts[:5], None])], ["doc", "text"])
    got = [x for b in lm_score._scorer(shared)(iter([batch])) for x in b.column("log_likelihood").to_pylist()]
    assert np.allclose(got, [*last, 0.0], rtol=1e-4)


def test_lm_training_visits_every_word(spark):
    """Over the default rounds every word of the corpus is a training target, and none twice."""
    texts = [prose(i, n) for i, n in enumerate([1, 2, 300, 5_000, 40])] + [None, ""]
    table = spark.createDataFrame([(x,) for x in texts], "text string").repartition(2).cache()
    lm_score.ship(spark)
    known = lm_score.vocabulary(table)
    shared = spark.sparkContext.broadcast((known, lm_score.first_parameters(known)))
    kind, n = "task long, block int, n long, values array<double>", 0
    for turn in range(lm_score.ROUNDS):
        found = table.mapInArrow(lm_score._trainer(shared, turn, lm_score.ONE_IN), kind)
        n += sum(r["n"] for r in found.filter("block = 0").select("n").collect())
    assert n == known.class_counts.sum() == 5_343


def test_lm_tail_follows_counts(spark, monkeypatch):
    """Every word has its share of the corpus, also those that no task holds; their counts are joined."""
    monkeypatch.setattr(lm_score, "KNOWN", 300)
    draw = np.random.default_rng(3)
    names = [f"w{i}" for i in range(900)]
    texts = [" ".join(names[int(k)] for k in 900 * draw.random(200) ** 3) for _ in range(40)]
    texts += [" ".join(names[600:]), texts[0], "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lm_score.ship(spark)
    known = lm_score.vocabulary(table.select("text"))
    assert 100 < len(known.hashes) <= 300
    words, n = np.unique(t.words(pa.array(texts), t.ALPHANUMERIC).hash, return_counts=True)
    rest = known.rest(known.rank(words))
    assert rest.sum() == len(words) - len(known.hashes) > 300
    classes, within = known.outputs(words)
    shares = known.class_counts / known.class_counts.sum()
    assert np.allclose(shares[classes] * np.exp(within) * np.where(rest, n, 1), n / n.sum())
    count, is_rest = dict(zip(words.tolist(), n)), set(words[rest].tolist())
    got = {r["doc_id"]: r for r in lm_score.score(table, rounds=0).withColumnRenamed("doc", "doc_id").collect()}
    assert len(got) == len(texts) and got[0]["log_likelihood"] == pytest.approx(got[41]["log_likelihood"], rel=1e-9)
    for i, plain in enumerate(plain_scores(texts, known, lm_score.first_parameters(known))):
        own = t.words(pa.array([texts[i]], pa.string()), t.ALPHANUMERIC).hash.tolist()
        expected = plain + sum(np.log(count[h]) for h in own if h in is_rest)
        assert got[i]["log_likelihood"] == pytest.approx(expected, rel=1e-4, abs=1e-9)
        assert got[i]["mean_log_likelihood"] == pytest.approx(expected / max(len(own), 1), rel=1e-4, abs=1e-9)


def test_probabilities_add_up(spark):
    table = spark.createDataFrame([("a b c d e f g a b a",), ("h i j a",)], "text string")
    lm_score.ship(spark)
    known = lm_score.vocabulary(table)
    words = t.words(pa.array(["a b c d e f g h i j"]), t.ALPHANUMERIC).hash
    classes, within = known.outputs(words)
    shares = known.class_counts / known.class_counts.sum()
    assert abs((shares[classes] * np.exp(within)).sum() - 1) < 1e-9


def best_containments(text, templates):
    """The scan's windows, looked at without bands."""
    found = t.words(pa.array([text], pa.string()), t.ALPHANUMERIC)
    hashes = t.shingle_hashes(found.hash, license_scan.SHINGLE)
    out = {}
    for name, own in templates.items():
        c = license_scan.size_class(len(own))
        for begin in range(0, len(hashes), 1 << c):
            share = len(np.intersect1d(hashes[begin : begin + 3 * (1 << c)], own)) / len(own)
            if share >= 0.8:
                out[name] = max(share, out.get(name, 0))
    return out


def test_license_scan(spark, odd_documents, no_documents):
    notices = list(license_scan.TEMPLATES.values())
    draw = np.random.default_rng(8)
    rows = []
    for i in range(60):
        words = notices[i % len(notices)].split()
        for j in np.flatnonzero(draw.random(len(words)) < draw.choice([0, 0.02, 0.05, 0.2])):
            words[j] = "changed"
        rows.append((i, f"{prose(i, 40)} {' '.join(words)} {prose(70 + i, 300)} {notices[(5 * i) % 16] if i % 3 else ''}"))
    sets = {name: license_scan.shingle_set(x) for name, x in license_scan.TEMPLATES.items()}
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    for r in license_scan.scan(documents).collect():
        expected = best_containments(rows[r["doc"]][1], sets)
        assert {m["name"]: round(m["containment"], 9) for m in r["matches"]} == {k: round(v, 9) for k, v in expected.items()}
    odd = license_scan.scan(odd_documents).collect()
    assert len(odd) == odd_documents.count() and all(r["matches"] == [] for r in odd)
    assert license_scan.scan(no_documents).count() == 0
    assert all(r["matches"] == [] for r in license_scan.scan(documents, {}).collect())
    with pytest.raises(ValueError):
        license_scan.scan(documents, {"short": "All rights reserved."})
