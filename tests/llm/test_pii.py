import hashlib
import random
import re
import time

import numpy as np

from threatsift.llm import gbdt, pii
from threatsift.llm.queries import QUERIES
from tests.conftest import SF_ORACLE
from tests.llm.helpers import SF, hard_docs, no_docs


def luhn_ok(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
               if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
                 if 16 <= len(digits(m.group())) <= 19 and luhn_ok(digits(m.group()))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15],
    }


PARTS = list("0123456789..@@aZ-+ ()\n%_é") + ["1.2.3.4", "4242 4242 4242 4242", "+1 (23) 456-7890", "a@b.c", "@", "..", "255.", "٣"]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(15_000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute(t), t


def test_hostile_texts_take_linear_time():
    n = 100_000
    began = time.time()
    for t in ("1" * n, "1." * n, "a" * n + "@", "a@" * n, "+1" * n, "+1" + "(" * n, "1 " * n, "12 " * n, "0:" * n, "a at " * n):
        pii.base_spans(t)
        pii.candidates(t)
    assert time.time() - began < 30


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_pii"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        base = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in want[k])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def _corpus(spark):
    rng = random.Random(3)
    words = "the of and to in is was for with on as by at from are this that be not have".split()
    rows = []
    for i in range(1500):
        w = [rng.choice(words) for _ in range(40)]
        card = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
        card += next(c for c in "0123456789" if luhn_ok(card + c))
        w[5] = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        w[15] = card
        w[25] = f"user{i}.{rng.randint(0, 99)}@mail{i % 7}.example.com"
        w[35] = ".".join(str(rng.randint(1, 250)) for _ in range(4))
        rows.append((i, " ".join(w) + " version 2.0.1 of 2021-03-04", "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


def test_trees_add_rewritten_forms_and_leave_plain_numbers(spark):
    model = pii.fit_pii(_corpus(spark))
    assert 0.5 <= model.threshold < 1
    def added(t):
        base = [(k, s, e) for k, spans in pii.base_spans(t).items() for s, e in spans]
        return {(k, t[s:e]) for k, s, e in model.select(t, base)}
    assert ("email", "jane.doe@example dot org") in added("write to jane.doe@example dot org for more") or \
        ("email", "jane.doe [at] example [dot] org") in added("write to jane.doe [at] example [dot] org for more")
    assert ("phone", "(415) 555-2671") in added("you can call (415) 555-2671 for it")
    for plain in ("in the years 1999-2004 and after", "the release 2021-03-04 of the", "version 10.2.33 of the", "a total of 12 345 678"):
        assert not added(plain), plain


def test_overlaps_are_resolved_by_score():
    trees = gbdt.constant(0.9)
    model = pii.Model(trees, 0.5)
    t = "call 415 555 2671 now or jane at mail dot org"
    spans = sorted((s, e) for _, s, e in model.select(t, []))
    assert spans and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert np.isclose(model.trees.probability(np.zeros((1, 3)))[0], 0.9)


def test_hard_rows_and_redaction(spark):
    docs = hard_docs(spark)
    model = pii.Model(gbdt.constant(0.5), 2.0)
    rows = pii.find_pii(docs, model).collect()
    assert len(rows) == docs.count() and all(r["spans"] == "" for r in rows)
    assert pii.find_pii(no_docs(spark)).count() == 0
    assert pii.redact(no_docs(spark)).count() == 0
    extra = spark.createDataFrame([(1, "mail a@b.co, or +1 (23) 456-7890!", 99, "keep"), (2, None, None, "k")],
                                  "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in pii.redact(extra, model).collect()}
    assert got[1]["text"] == "mail <EMAIL>, or <PHONE>!" and got[1]["n_chars"] == 25 and got[1]["spans"] == "keep"
    assert got[2]["text"] is None and got[2]["n_chars"] is None


def test_written_addresses_are_proposed_in_texts_of_any_length_and_case():
    forms = ("JANE.DOE AT EXAMPLE DOT ORG", "JOE [AT] MAIL [DOT] COM", "Ann (At) host.org", "jane { at } example.org",
             "jane.doe at example dot org", "jane ( at] example.org")
    for form in forms:
        for pad in ("", "word " * 20_000):
            t = f"{pad}; {form}; {pad}"
            assert ("email", t.index(form), t.index(form) + len(form)) in pii.candidates(t), (form, len(t))


def test_every_sign_proposes_its_whole_address():
    """No hint, no window: what the generator accepts is proposed, to its end."""
    label = "h" * 63
    long = "n" * 64 + "@" + ".".join([label] * 4) + "-"
    cases = ["write jane.doe at example.org now", "joe {at} a-b.example (dot) net", "x@y.zz", "a at at b.cc", "Ann [ AT ] host [DOT] org",
             "me at one.two at three.four", "q" * 300 + " ann at host.org", long]
    for text in cases:
        whole = re.compile(rf"(?<![\w.+-])[\w.+-]{{1,64}}{pii._AT}[\w-]{{1,63}}(?:{pii._DOT}[\w-]{{1,63}}){{1,4}}(?![\w-])", re.I)
        want = {("email", *whole.match(text, i).span()) for i in range(len(text)) if whole.match(text, i)
                and not re.match(r"[\w.+-]", text[i - 1:i])}
        got = {c for c in pii.candidates(text) if c[0] == "email"}
        assert want <= got, text
    address = "n" * 64 + "@" + ".".join(["h" * 63] * 4) + ".example"
    assert ("email", 4, 4 + len(address)) in pii.candidates("see " + address + " ok")


# Written by hand, not by the rules that make the training rows: (text, personal spans).
LABELLED = [
    ("You can write to jane.doe at example dot org any time.", ["jane.doe at example dot org"]),
    ("Contact: m.weber [at] firma-nord [dot] de, thanks", ["m.weber [at] firma-nord [dot] de"]),
    ("reach bob_99 (at) mail.example.com or call", ["bob_99 (at) mail.example.com"]),
    ("mail sara(at)post(dot)example(dot)fr please", ["sara(at)post(dot)example(dot)fr"]),
    ("My phone is (415) 555-2671, evenings only.", ["(415) 555-2671"]),
    ("call 212-555-0187 or text", ["212-555-0187"]),
    ("phone 646.555.0122 for the keys", ["646.555.0122"]),
    ("tel 303 555 0145 extension none", ["303 555 0145"]),
    ("card 3782 822463 10005 expires soon", ["3782 822463 10005"]),
    ("visa 378282246310005 on file", ["378282246310005"]),
    ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    ("We met at noon. The report, version 2.13.7, is due 2024-05-17.", []),
    ("Years 1998-2004 and 1914-1918, order 4711 0815 in total.", []),
    ("ISBN 978-3-16-148410-0 on page 1024", []),
    ("She arrived at home. Nobody looked at it dot by dot.", []),
]


def test_recall_and_precision_of_added_spans(spark):
    model = pii.fit_pii(spark.read.parquet(f"{SF_ORACLE}/documents.parquet"))
    found = wrong = wanted = 0
    for text, spans in LABELLED:
        base = [(k, s, e) for k, found_ in pii.base_spans(text).items() for s, e in found_]
        got = {text[s:e] for _, s, e in base + model.select(text, base)}
        wanted += len(spans)
        found += len(got & set(spans))
        wrong += len(got - set(spans))
    print("recall", found, wanted, "wrong", wrong)
    assert found >= 0.8 * wanted and wrong <= 2


def test_a_hot_id_does_not_flood_the_sample(spark):
    rows = [(None, "mail a@b.cc or +1 415 555 2671 now")] * 3_000 + [(i, f"n{i}@host.org") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.fit_pii(df, sample_docs=3_000).threshold > 0
    assert pii.find_pii(df).count() == 3_050


def test_the_fit_sees_every_row(spark):
    """Personal data only in long texts, and in more documents than a sample would hold."""
    pad = "word " * 2_500
    long = spark.createDataFrame([(r["doc_id"], pad + r["text"]) for r in _corpus(spark).limit(40).collect()], "doc_id long, text string")
    assert 0.5 <= pii.fit_pii(long).threshold < 1
    many = spark.range(9_000).selectExpr("id AS doc_id", "concat('mail user', id, '@host', id, '.org now') AS text")
    repeated = many.unionByName(many.limit(50))                  # equal documents count once
    total = pii.training_table(repeated).agg({"n": "sum"}).first()[0]
    assert total == 7 * 9_000


def test_the_fit_on_the_cluster_is_the_fit_of_all_rows(spark):
    docs = _corpus(spark).select("doc_id", "text").limit(300).unionByName(
        spark.createDataFrame([(10_000, "years 1998 2004 in 4711 0815 or 12 345 678 9"), (10_000, None), (None, "n 11 22 33 44 5"), (10_001, "")],
                              "doc_id long, text string"))
    texts = {tuple(r) for r in docs.collect()}
    made = [row for _, t in texts for row in pii._training_rows(t or "")]
    x, y = np.array([a for a, _ in made]), np.array([b for _, b in made])
    half = np.array([int(hashlib.md5(r.tobytes()).hexdigest()[:8], 16) % 2 for r in x])
    want = gbdt.fit(x[half == 0], y[half == 0], trees=40, depth=4, min_hessian=1.0)
    model = pii.fit_pii(docs.repartition(5))
    assert np.isclose(model.trees.base, want.base)
    assert np.abs(model.trees.probability(x) - want.probability(x)).max() < 0.02
    table = pii.training_table(docs)
    edges = pii.quantile_edges(table.where("half = 0"), int((half == 0).sum()))
    assert all(np.array_equal(a, b) for a, b in zip(edges, gbdt.bin_edges(x[half == 0], pii.BINS)))
    again = pii.fit_pii(docs.repartition(2))                     # however the rows are dealt
    assert all(np.array_equal(getattr(model.trees, k), getattr(again.trees, k)) for k in ("feature", "threshold", "leaf"))
    score, truth = model.trees.probability(x[half == 1]), y[half == 1]
    good = [s for s in np.unique(score) if truth[score >= s].mean() >= pii.PRECISION]
    assert model.threshold == again.threshold == max(0.5, min(good))
