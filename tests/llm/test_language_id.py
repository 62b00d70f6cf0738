"""The network against finite differences and a step-by-step reading; predictions by held-out accuracy."""
import math

import numpy as np
import pytest

from fleetweave.llm import language_id
from fleetweave.llm.language_id import HIDDEN, Network


def test_gradients_by_finite_differences():
    network = Network.fresh(["a", "b", "c"])
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    words, labels = [b" hello ", "dés ".encode(), b" x "], np.array([0, 2, 1])
    _, grads = language_id.gradients(network, words, labels)
    for name, g in grads.items():
        weight = network.weights[name]
        for place in np.argsort(-np.abs(g), axis=None)[:4]:
            at, step = np.unravel_index(place, weight.shape), 1e-3
            losses = []
            for sign in (1, -1):
                weight[at] += sign * step
                losses.append(language_id.gradients(network, words, labels)[0])
                weight[at] -= sign * step
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2 / step, rel=2e-2, abs=1e-5), (name, at)


def read(weights, way, word):
    """One direction, one byte at a time, as the definition of the unit has it."""
    h, out = np.zeros(HIDDEN), []
    for byte in word:
        x, u = weights["x" + way][byte], h @ weights["u" + way]
        z, r = (1 / (1 + np.exp(-(x + u)[k * HIDDEN:(k + 1) * HIDDEN])) for k in (0, 1))
        c = np.tanh(x[2 * HIDDEN:] + r * u[2 * HIDDEN:])
        h = z * h + (1 - z) * c
        out.append(h)
    return out


def test_pooled_probabilities_by_single_steps():
    network = Network.fresh(["a", "b"], seed=4)
    text = "Été à la mer, 12 fois! " + "y" * 130
    total, letters = np.zeros(2), 0
    for word in text.encode().split():
        for k in range(0, len(word), language_id.PIECE):
            piece = b" " + word[k:k + language_id.PIECE] + b" "
            ahead, behind = read(network.weights, "f", piece), read(network.weights, "b", piece[::-1])[::-1]
            for byte, f, b in zip(piece, ahead, behind):
                if chr(byte).isalpha() and byte < 128 or byte > 127:
                    e = np.exp(f @ network.weights["of"] + b @ network.weights["ob"] + network.weights["bias"])
                    total += e / e.sum()
                    letters += 1
    found = language_id.probabilities(network, [b"", text.encode(), b" 1 ", text.encode() * 2])
    assert found[1] == pytest.approx(total / letters, abs=1e-4)
    assert found[0].sum() == found[2].sum() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language_id.train(docs)
    rows = language_id.predict(docs, network).join(docs.withColumnRenamed("doc_id", "id"), "id").collect()
    held = [r for r in rows if language_id.is_held_out(r["id"], 3, 1)]
    right = sum(r["lang_pred"] == r["lang"] for r in held)
    assert len(rows) == 1000 and len(held) > 250 and right / len(held) > 0.96
    assert all(0 < r["score"] <= 1 and math.isfinite(r["score"]) for r in rows)


def test_awkward_rows(spark, awkward):
    network = language_id.fit([(b"hello world the and", "en"), ("der die das und über".encode(), "de")] * 5)
    found = {(r["id"], r["lang_pred"]) for r in language_id.predict(awkward, network).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und")} <= found
    assert {p for i, p in found if i in (4, 5, 8, 10, 11)} <= {"en", "de"}
    assert language_id.predict(awkward, network).count() == awkward.count()


def test_nothing_learned(spark, no_rows, awkward):
    docs = awkward.selectExpr("doc_id", "text", "cast(null as string) as lang")
    network = language_id.train(docs)
    assert network.languages == [] and {r["lang_pred"] for r in language_id.predict(docs, network).collect()} == {"und"}
    assert language_id.predict(no_rows, network).count() == 0


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "only here" if language_id.is_held_out(i, 3, 1) else f"common words {i}",
             "xx" if language_id.is_held_out(i, 3, 1) else "yy") for i in range(60)]
    network = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert network.languages == ["yy"]


@pytest.mark.parametrize("copies_first", [True, False])
def test_copies_do_not_crowd_the_sample(spark, copies_first):
    """Five thousand copies of a text that is drawn anyway leave all languages and all other texts where they were."""
    draw = np.random.default_rng(3)
    words = {lang: [f"{lang}{k}" for k in range(50)] for lang in ("en", "fr", "de", "es")}
    rows = [(k, " ".join(draw.choice(words[lang], 20)), lang) for k, lang in enumerate(list(words) * 250)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wanted = language_id.sample(plain, "text", "lang")
    hot = next(t for t, lang in wanted if lang == "en").decode()
    copies = [(2000 + k, hot, "en") for k in range(5000)]
    docs = spark.createDataFrame(copies + rows if copies_first else rows + copies, plain.schema)
    assert language_id.sample(docs, "text", "lang") == wanted
    assert {lang for _, lang in wanted} == set(words) and len({t for t, _ in wanted}) == len(wanted) == 1000


def test_the_sample_is_bounded_and_keeps_every_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 12)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 300)
    rows = [(k, f"text {k} of {k % 3}", f"l{k % 3}") for k in range(90)] + [(100, "z" * 5000, "long"), (101, "y" * 400, "l0")]
    found = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang")
    assert {lang for _, lang in found} == {"l0", "l1", "l2", "long"} and len(found) <= 12
    assert sum(len(t) for t, lang in found if lang != "long") <= 300
    rows = [(k, f"text {k}", f"l{k}") for k in range(40)]
    assert len(language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang")) == 12
