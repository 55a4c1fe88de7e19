"""Occlusion against a plain loop over the texts, with Python models."""

import re
from functools import partial

import numpy as np
import pytest

from threatsift.operators import occlusion as OC
from threatsift.operators.model import hashed_linear_model
from threatsift.operators.scoring import EMAIL_CLASSES, URL_CLASSES, LexicalScorer, PandasScorer, RuleScorer


def crooked_model(n_classes):
    """A model that is not linear in its words."""
    base = hashed_linear_model(n_classes, 256, 3)

    def predict(texts):
        out = base(texts)
        out[:, 0] += [len(set(t.split())) % 3 for t in texts]
        out[:, -1] *= [1 + t.count("verify") ** 2 for t in texts]
        return out

    return predict


TEXTS = ["verify your account now", "verify verify  offer\n日本 verify", "", None, "   ", "x", " lead and trail ",
         " ".join(f"w{i}" for i in range(40))]


def _loop(texts, predict, classes, most, target=None):
    def p(t):
        z = predict([t])[0]
        e = np.exp(z - z.max())
        return e / e.sum()

    rows = {}
    for key, text in enumerate(texts):
        pieces = re.findall(r"\s*\S+", text or "")[:most]
        whole = p("".join(pieces))
        k = classes.index(target) if target else int(np.argmax(whole))
        for i, token in enumerate(pieces):
            rest = p("".join(pieces[:i] + pieces[i + 1:]))
            rows[key, i] = (classes[k], token, abs(whole[k] - rest[k]))
    return rows


@pytest.mark.parametrize("target", [None, "spam"])
@pytest.mark.parametrize("most", [3, 510])
def test_any_python_model(spark, target, most):
    from threatsift.session import ship_package
    ship_package(spark)
    df = spark.createDataFrame([(i, t, target, 0.5) for i, t in enumerate(TEXTS)],
                               "pos long, text string, target string, p_spam double")
    scorer = PandasScorer(partial(crooked_model, 3), EMAIL_CLASSES, batch_size=4)
    keyed = df.withColumnRenamed("pos", "row")
    got = OC.occlusion(keyed, ["row"], "text", scorer, "target" if target else None, max_pieces=most)
    want = _loop(TEXTS, crooked_model(3), list(EMAIL_CLASSES), most, target)
    rows = {(r["row"], r["pos"]): (r["target"], r["token"], r["importance"]) for r in got.collect()}
    assert rows.keys() == want.keys()
    for k, (cls, token, imp) in want.items():
        assert rows[k][:2] == (cls, token) and rows[k][2] == pytest.approx(imp, abs=1e-12)


def test_url_pieces_rebuild_the_url_and_nothing_is_shuffled(spark):
    urls = ["http://login-verify.example.org/a?b=c", "", None, "no separators", "日本.example/%20"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    out = OC.occlusion(df, ["page_id"], "url", LexicalScorer("url"), pieces=OC.url_pieces)
    built = {}
    for r in sorted(out.collect(), key=lambda r: (r["page_id"], r["pos"])):
        built[r["page_id"]] = built.get(r["page_id"], "") + r["token"]
        assert r["target"] in URL_CLASSES
    assert built == {i: u for i, u in enumerate(urls) if u}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert OC.occlusion(df.limit(0), ["page_id"], "url", LexicalScorer("url")).count() == 0


def test_a_scorer_without_probabilities_is_refused(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    with pytest.raises(NotImplementedError):
        OC.occlusion(df, ["id"], "text", RuleScorer(("a",)))
