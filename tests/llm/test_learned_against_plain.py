"""Scores of the byte network and of the subword bags against plain loops over bytes, windows and words."""

import math
import re

import numpy as np

from marginalia.llm import language_id, toxicity

TEXTS = ["", "a", "Zuz zoz", "aba ABO\n" * 90, "ünï çödé 漢字 x1", "z" * 256, "z" * 257 + "é" * 300, "1 22 333 ,.;", "Word " * 75]


def plain_languages(net, text):
    """Shares of the languages: mean log-probabilities of the windows, normalised."""
    data, size = text.encode(), language_id.WINDOW
    total, n = np.zeros(len(net.languages)), 0
    for begin in range(0, len(data), size):
        window = data[begin : begin + size].ljust(size, b"\0")
        pooled = []
        for width, filters, bias in zip(language_id.WIDTHS, net.filters, net.biases):
            best = [-math.inf] * filters.shape[1]
            for place in range(size - width + 1):
                under = [x for byte in window[place : place + width] for x in net.embedding[byte]]
                answers = np.asarray(under, dtype=np.float64) @ filters
                best = [max(a, b) for a, b in zip(best, answers)]
            pooled += [max(0.0, b + s) for b, s in zip(best, bias)]
        z = [sum(p * w for p, w in zip(pooled, net.output[:, c])) + net.shift[c] for c in range(len(net.languages))]
        total += np.array(z) - math.log(sum(math.exp(x) for x in z))
        n += 1
    mean = total / max(n, 1)
    return np.exp(mean) / np.exp(mean).sum()


def test_language_scores_equal_a_plain_convolution(spark):
    draw = np.random.default_rng(3)
    net = language_id.new_network(("aa", "bb", "cc"), 5)
    net = net._replace(
        biases=tuple(draw.normal(0, 0.5, b.shape).astype(np.float32) for b in net.biases),
        shift=draw.normal(0, 0.5, 3).astype(np.float32),
    )
    rows = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    found = {r["row"]["doc_id"]: r for r in language_id.identify(rows, net).collect()}
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        if not any(c.isalpha() for c in text):
            assert (found[i]["language"], found[i]["score"]) == ("und", 0.0)
            continue
        shares = plain_languages(net, text)
        assert found[i]["language"] == net.languages[int(shares.argmax())]
        assert abs(found[i]["score"] - shares.max()) < 1e-4


def plain_bucket(gram):
    h = len(gram)
    for byte in gram:
        h = (h * 0x01000193) % (1 << 32) ^ byte
    return h * 0x9E3779B1 % (1 << 32) >> (32 - 17)


def plain_toxicity(model, text):
    """The largest probability over windows of words; a word is the mean of its n-grams' vectors."""
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    vectors = []
    for word in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered):
        marked = b"<" + word + b">"
        grams = [marked[i : i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        vectors.append(sum(model.table[plain_bucket(g)].astype(np.float64) for g in grams) / len(grams))
    begins = [0]
    while begins[-1] + toxicity.WINDOW < len(vectors):
        begins.append(begins[-1] + toxicity.STEP)
    scores = []
    for begin in begins:
        own = vectors[begin : begin + toxicity.WINDOW]
        mean = sum(own) / len(own) if own else np.zeros(toxicity.DEPTH)
        z = mean @ model.softmax + model.shift
        scores.append(1 / (1 + math.exp(z[0] - z[1])))
    return max(scores)


def test_toxicity_scores_equal_plain_bags(spark):
    draw = np.random.default_rng(6)
    normal = lambda *shape: draw.normal(0, 1.0, shape).astype(np.float32)
    model = toxicity.Model(normal(toxicity.BUCKETS, toxicity.DEPTH), normal(toxicity.DEPTH, 2), normal(2))
    words = ["awful", "day", "x", "ünï", "42", "naïve"]
    texts = [*TEXTS, *[" ".join(draw.choice(words, n)) for n in (1, 2, 7, 8, 9, 40, 63, 64, 65, 200)]]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r["doc"]: r["score"] for r in toxicity.toxicity(rows, model).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert abs(found[i] - plain_toxicity(model, text)) < 1e-5, text[:50]
