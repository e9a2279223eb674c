import hashlib
import re

from pyspark.sql import functions as F

from tablecare.llm import pii
from tablecare.llm.frames import durable
from tablecare.llm.pii import chosen_spans, estimate, fit_pii, redact, with_candidates
from tablecare.llm.queries import QUERIES
from tests.llm.tables import TEXTS, awkward, empty


def luhn(digits):
    doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
}
HARD = [
    *TEXTS,
    "a@b@c.d x@y.z. <me@host> me@host.de, first.last+tag@sub-domain.example.co.uk a@b.c%d@e.f",
    "1.2.3.4.5 1.2.3 01.002.0003.255 256.1.1.1 1.2.3.256 99999999999999999999.1.1.1",
    "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 4111  1111 1111 1111 1 2",
    "+1 (437) 555-0689 +49.30.123456 +1-2 +12345678901234567 ++33 1 23 45 67 89 (437) 555-0689 437-555-0689",
    "é" * 20 + " mail: ü.x@ex.com 😀😀 10.0.0.1",
    "1 " * 20_000,
    "a." * 5_000 + "b@c.d" + ".e" * 20_000,
    "9" * 100_000,
    "x@" * 5_000,
    "from 10.0.0.1 to 192.168.1.77; " * 400,
]


def base_spans(text):
    out = {}
    for kind, (pattern, passes) in BASE.items():
        out[kind] = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if passes(m.group())]
    return out


def test_base_spans_equal_plain_matching(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op10_pii"](spark, str(tmp_path)).collect()}
    assert len(got) == len(HARD)
    for i, text in enumerate(HARD):
        want = base_spans(text or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()], text[:60]
        every = ",".join(s for v in want.values() for s in v)
        assert r.base_sha256 == hashlib.sha256(every.encode()).hexdigest()
        assert {s for v in want.values() for s in v} <= set(r.spans.split(","))


def test_no_python_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = redact(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_estimation_tells_good_labelers_from_bad():
    # the first two agree, the fourth votes at random
    patterns = {
        (0, "1,1,0,1,1"): 400, (0, "1,1,0,-1,1"): 400, (0, "-1,-1,0,1,-1"): 300, (0, "-1,-1,0,-1,-1"): 300, (0, "1,-1,0,1,-1"): 20,
    }
    reliability, prior, belief = estimate(patterns)
    assert reliability[0, 0][0] > 0.95 > 0.6 > reliability[0, 3][0] > 0.4
    assert belief[0, "1,1,0,-1,1"] > 0.95 and belief[0, "-1,-1,0,1,-1"] < 0.05 and 0.4 < prior[0] < 0.7


def test_spelt_out_addresses_join_the_base(spark):
    rows = [(i, f"please mail: user{i}@host{i % 7}.com or write to some.one{i} (at) mail{i % 5}.org today") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = durable(with_candidates(docs, "text", "c"))
    spans = marked.select(F.explode(chosen_spans(F.col("c"), fit_pii(marked, "c"))).alias("s"))
    assert spans.where("s.base").count() == 200 and spans.where("NOT s.base").count() == 200


def test_the_gate_lets_every_loose_address_through(spark, monkeypatch):
    texts = ["jane(AT)example.com", "JANE[AT]EXAMPLE.ORG", "jane@example .com", "jane@example. com", "jane@example(DOT)com",
             "jane @example.com", "jane (At) example [Dot] com", "plain jane@example.com", "no address here", "(at)"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def proposed():
        return {r.doc_id: r.c for r in with_candidates(docs, "text", "c").collect()}

    gated = proposed()
    monkeypatch.setattr(pii, "GATE", "")
    assert gated == proposed()
    assert all(any(c.kind == 0 for c in gated[i]) for i in range(8)) and not gated[8] and not gated[9]


def test_redaction_of_many_spans(spark):
    docs = spark.createDataFrame([(1, "é😀 from 10.0.0.1 to +1 (437) 555-0689; " * 300 + "end")], "doc_id long, text string")
    assert redact(docs).first().text == "é😀 from [IP] to [PHONE]; " * 300 + "end"


def test_redaction_of_awkward_rows(spark):
    docs = awkward(spark)
    got = redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by_id = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert by_id[12].text.startswith("ünïcödé 日本語 😀 mail me: [EMAIL] or [PHONE], [IP], [CARD] <|endoftext|>")
    assert by_id[12].n_chars == len(by_id[12].text)
    assert by_id[3].text is None and by_id[1].text == TEXTS[0] and by_id[9].text == TEXTS[8]
    assert redact(empty(spark)).count() == 0


def test_running_folds(spark):
    rows = [(n, [(i * 37) % 11 for i in range(n)]) for n in (0, 1, 2, 127, 128, 129, 300, 1000)]
    frame = spark.createDataFrame(rows, "n int, v array<int>")
    got = pii.with_running(pii.with_running(frame, {"total": "v"}, 0, lambda a, b: a + b), {"top": "v", "blocks_0": "v"}, 0, F.greatest)
    assert got.columns == ["n", "v", "total", "top", "blocks_0"]
    for r in got.collect():
        assert r.total == [sum(r.v[:i]) for i in range(r.n)]
        assert r.top == r.blocks_0 == [max([0, *r.v[:i]]) for i in range(r.n)]


def test_loose_spans_beside_base_spans(spark):
    """Which loose spans stay, against testing every pair."""
    texts = ["call 437-555-0689, or +1 437-555-0689; 4111-1111-1111-1111 x me (at) here.org a@b.com " * n for n in (1, 3, 60)]
    marked = with_candidates(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "c")
    for r in marked.collect():
        base = [(c.start, c.stop) for c in r.c if c.base]
        assert base and all(c.base or not any(a < c.stop and c.start < b for a, b in base) for c in r.c)
        n = r.text.count("me (at)")
        assert sum(not c.base for c in r.c) >= 2 * n and sum(c.base for c in r.c) >= 2 * n
