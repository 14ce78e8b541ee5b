import duckdb
import pytest
from pyspark.sql import functions as F

from maskloom.functions.dialect import java, python
from maskloom.functions.language import detect_language
from maskloom.functions.spans import spans
from maskloom.operators import anonymize as A
from maskloom.operators import evaluate as E
from maskloom.operators import ner
from maskloom.operators import patterns as P
from maskloom.operators import synthesize as S
from maskloom.operators import vault as V
from maskloom.operators.registry import Registry
from maskloom.operators.resolve import resolve, resolve_col
from maskloom.operators.shapes import TOKENS, is_structural, rejected
from maskloom.plans.analyze import FINDINGS_DDL, AnalysisConfig, analyze, exploded
from maskloom.queries import ORACLES, QUERIES
from maskloom.sources import formats as X

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        return
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(_norm(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert sorted(tuple(_norm(r[c]) for c in order) for r in rows) == want


def _same_as_sql(spark, folder, names, **tables):
    """Queries against their SQL over tables made here."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    for name in names:
        df, cur = QUERIES[name](spark, str(folder)), con.execute(ORACLES[name])
        at = [[c[0] for c in cur.description].index(c) for c in df.columns]
        assert sorted(tuple(map(_norm, r)) for r in df.collect()) == sorted(tuple(_norm(r[i]) for i in at) for r in cur.fetchall()), name


@pytest.fixture(scope="module")
def neighbours(spark):
    """Documents with addresses side by side."""
    texts = ["mail a@b.co c@d.org now", "x@y.com\nx@y.com z@y.com, q@y.com", "ä😀 a@b.co\t\r\n b@b.co", "a@b.co", "no address", "", None]
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_addresses_side_by_side_are_rewritten_one_by_one(spark, neighbours, tmp_path):
    names = ["anonymize_email", "op_replace", "op_replace_value", "op_redact", "op_mask", "op_mask_part", "op_hash256", "op_keep", "op_detect_only"]
    _same_as_sql(spark, tmp_path, names, documents=neighbours)


def test_addresses_side_by_side_have_tokens_of_their_own(spark, neighbours, tmp_path):
    _same_as_sql(spark, tmp_path, ["tokens_mint", "tokens_detokenize", "tokens_unlinked", "tokens_reveal_identity", "vault_delete"], documents=neighbours)


def test_structural_surfaces_leave_plain_words_alone(spark, tmp_path):
    """Only tokens that can have a shape are taken out of a text, and all that have one are."""
    import random

    rng = random.Random(4)
    made = ["".join(rng.choice(rng.choice(["abf", "AB", "09", "_", "-", ".", "xyz", "/+=@"])) for _ in range(rng.choice([1, 3, 6, 16, 17, 24, 30]))) for _ in range(3000)]
    made += ["deadbeefdeadbeef", "abcdefabcdefabcd.", "a" * 15 + ".", "f" * 16, "abcdefghijklmnopqrstuvwxyz", "a.b.c.", "a.b", "de-CH", "v1.2", "x1", "MAX_A", "Anna_Lee", "e.g."]
    texts = [" ".join(made), "," + ", ".join(made[:500]) + ".", "ä" + "ß".join(made[500:900]), "just plain words here.", "", None, "deadbeefdeadbeef"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    _same_as_sql(spark, tmp_path, ["structural_surfaces"], documents=docs)
    tokens = {t for r in docs.select(F.regexp_extract_all("text", F.lit(TOKENS), F.lit(0)).alias("t")).where("doc_id < 4").collect() for t in r.t}
    assert {t for t in made if is_structural(t)} <= tokens and "words" not in tokens and "here." not in tokens


def test_ascii_boundaries_in_catalyst(spark):
    got = spark.createDataFrame([(" Österreich",)], "t string").select(F.regexp_extract("t", java(r"\b[A-Za-zÄÖÜ][a-zäöüß]+"), 0)).first()[0]
    assert got == "sterreich"


def test_spans_offsets_are_code_points(spark):
    r = spark.createDataFrame([("ä😀 a@b.co, c@d.org",), (None,), ("",)], "t string").select(spans(F.col("t"), r"[a-z]@[a-z.]+", "@").alias("s")).collect()
    assert [(x.start, x.end, x.surface) for x in r[0].s] == [(3, 9, "a@b.co"), (11, 18, "c@d.org")] and r[1].s == [] and r[2].s == []


def test_spans_run_the_pattern_once_and_take_marks_for_text(spark):
    texts = ["A1234567 then AB123456, 123456789.", "", None, "none", "\ufdd0A1234567\ufdd1 ä😀 123456789", "\ufdd1 x", "A1234567", "xA1234567 A1234567", "1 A1234567\n123456789"]
    x = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    for needs in (None, "[0-9]{6}"):
        got = {r.i: [tuple(s) for s in r.s] for r in x.select("i", spans(F.col("t"), P.US_DRIVER_LICENSE, needs).alias("s")).collect()}
        assert got == {i: [(*m.span(), m[0]) for m in python(P.US_DRIVER_LICENSE).finditer(t or "")] for i, t in enumerate(texts)}
    plan = x.select(spans(F.col("t"), P.US_DRIVER_LICENSE).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_analyze_keeps_columns_and_handles_nulls(spark):
    df = spark.createDataFrame([(1, "a@b.co", "en", 9), (2, None, None, 8), (3, "", "xx", 7)], "doc_id int, text string, lang string, start int")
    out = analyze(df, language="lang")
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "start", "findings"] and len(rows[1].findings) == 1 and rows[2].findings == [] and rows[3].findings == []
    assert exploded(analyze(df.limit(0)), ["doc_id"]).collect() == []


def test_resolve_column_is_the_fold(spark):
    import random

    rng = random.Random(3)
    names = ["GLiNERPool", "AUTFNRecognizer", "DEPostalCodeRecognizer", "Z"]
    rows = [(i, [(s := rng.randrange(20), s + rng.randrange(1, 9), rng.choice([0.3, 0.5, 0.9]), rng.choice(["PERSON", "POSTAL_CODE", "AU_TFN", "LOCATION"]), rng.choice(names)) for _ in range(rng.randrange(8))]) for i in range(200)]
    got = spark.createDataFrame(rows, f"i int, f {FINDINGS_DDL}").select("i", resolve_col(F.col("f")).alias("r")).collect()
    for r in got:
        assert [tuple(x) for x in r.r] == resolve(rows[r.i][1])


def test_rewriting(spark):
    df = spark.createDataFrame([("call Anna Lee at x", [(5, 9, 0.9, "PERSON", "A"), (10, 13, 0.5, "PERSON", "A"), (17, 18, 0.4, "ID", "B")]), ("none", [])], f"text string, findings {FINDINGS_DDL}")
    r = A.anonymize(df).collect()
    assert r[0].anonymized == "call <PERSON> at <ID>" and r[1].anonymized == "none"
    assert [(i.start, i.end, i.entity, i.operator, i.text) for i in r[0]["items"]] == [(5, 13, "PERSON", "replace", "<PERSON>"), (17, 21, "ID", "replace", "<ID>")]
    cfg = A.AnonymizerConfig({"PERSON": A.mask("#!", 4, True), "*": A.redact()}, allow=("X",))
    assert A.anonymize(df, cfg).first().anonymized == "call Anna#### at x"
    bad = spark.createDataFrame([("ab", [(1, 5, 0.9, "ID", "A")])], f"text string, findings {FINDINGS_DDL}")
    with pytest.raises(Exception, match="outside"):
        A.anonymize(bad).collect()
    with pytest.raises(ValueError):
        A.hash_("md5")


def test_synthetic_values():
    from maskloom.functions import checksums as C

    for i in range(50):
        rng = lambda e, s, w=str(i): S.seeded(e, s, w)  # noqa: E731, B008
        card = S.synthetic("4111-1111-1111-1111", "CREDIT_CARD", rng("C", "4"))
        assert C.luhn(card.replace("-", "")) and [k for k, c in enumerate(card) if c == "-"] == [4, 9, 14]
        assert C.iban(S.synthetic("DE89 3704 0044 0532 0130 00", "IBAN_CODE", rng("I", "x")).replace(" ", ""))
        assert S.synthetic("10.1.2.3", "IP_ADDRESS", rng("P", "x")).startswith("10.")
        assert C.us_ssn(S.synthetic("123-45-6789", "US_SSN", rng("S", "x")).replace("-", ""))
        mac = S.synthetic("AA-BB-CC-00-11-22", "MAC_ADDRESS", rng("M", "x"))
        assert int(mac[:2], 16) & 3 == 2 and mac.count("-") == 5
    assert S.synthetic("a", "PERSON", S.seeded("PERSON", "a")) == S.synthetic("a", "PERSON", S.seeded("PERSON", "a"))


def test_vault_round_trip(spark):
    docs = spark.createDataFrame(
        [
            ("t-1", "a", "mail a@b.co, again a@b.co or c@d.co", "text"), ("t-1", "b", '{"z":"a@b.co","n":1.5,"k":[null,"x"]}', "json"), ("t-1", "c", "plain a@b.co\n{\"m\":\"q@r.co\"}\n", "logs"),
            ("t-2", "d", "nothing here", "text"),
        ],
        "tenant_id string, id string, content string, fmt string",
    )
    reg = Registry([r for r in Registry().snapshot() if r.name == "EmailRecognizer"])
    records, vault = V.ingest(docs, registry=reg, format_column="fmt")
    records, vault = records.cache(), vault.cache()
    by = {r.id: r for r in records.collect()}
    assert by["a"].anonymized_content == "mail <EMAIL_ADDRESS_T_1_000001>, again <EMAIL_ADDRESS_T_1_000001> or <EMAIL_ADDRESS_T_1_000002>"
    assert by["d"].anonymized_content == "nothing here" and by["d"].tokens == []
    shown = {r.id: r.content for r in V.reveal(records, vault).collect()}
    assert shown["a"] == "mail a@b.co, again a@b.co or c@d.co" and shown["b"] == '{"k":[null,"x"],"n":1.5,"z":"a@b.co"}' and shown["c"] == 'plain a@b.co\n{"m":"q@r.co"}\n'
    key = b"k" * 32
    assert sorted(r.cleartext for r in V.decrypted(V.encrypted(vault, key), key).collect()) == sorted(r.cleartext for r in vault.collect())
    v2, r2, n = V.delete(vault, records, docs.where("id = 'a'"))
    assert v2.where("id = 'a'").count() == 0 and r2.count() == 3 and n.first().tokens_deleted == 2
    assert V.delete(v2, r2, docs.where("id = 'a'"))[2].count() == 0
    expired = vault.withColumn("expires_at", F.lit("2001-01-01").cast("timestamp"))
    assert V.alive(expired).count() == 0


def test_arrow_passes_bound_their_batches(spark):
    """A worker holds 4 MB of texts at a time, however many and long they are: 40 texts of 1 MB never come in one batch."""
    import pyarrow as pa

    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(40, numPartitions=1).select(F.lit("t").alias("tenant_id"), F.col("id").cast("string").alias("id"), F.repeat(F.lit("word a@b.co "), 90_000).alias("content"), F.lit("text").alias("fmt"))
    mail = Registry([r for r in Registry().snapshot() if r.name == "EmailRecognizer"])

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    for call in (
        lambda: analyze(docs, text="content", registry=mail), lambda: S.synthesize_texts(docs.withColumn("findings", F.array().cast(FINDINGS_DDL)), text="content"), lambda: X.segments(docs, ["id"], "content", F.lit("text")),
        lambda: X.rebuild(docs.withColumn("new", F.lit(None).cast("map<string,string>")), "content", F.lit("text"), "new"), lambda: V.reveal(docs.select("tenant_id", "id", F.col("content").alias("anonymized_content"), F.col("fmt").alias("content_format")), docs.select("tenant_id", "id", F.lit("x").alias("token"), F.lit("y").alias("cleartext"), F.lit(None).cast("timestamp").alias("expires_at"))),
    ):
        spark.conf.set(key, "64m")
        call()
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 5
        spark.conf.set(key, "1m")  # a lower bound of the user's stays
        call()
        assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_formats(spark):
    assert X.segments_of('{"b":["x",{"a":"y"}],"a":1}', "json") == [("$.b[0]", "x"), ("$.b[1].a", "y")]
    with pytest.raises(ValueError):
        X.segments_of('{"a":1}\nno', "ndjson")
    assert X.rebuilt('{"b":"ü","a":1}', "json", {"$.b": "<X>"}) == '{"a":1,"b":"<X>"}'
    r = spark.createDataFrame([(" LOG ", '{"a":1}\n{"b":2}'), ("nope", "[1]"), (None, "x")], "f string, t string").select(X.normalize_format(F.col("f")), X.resolve_auto(F.col("t"))).collect()
    assert [tuple(x) for x in r] == [("logs", "ndjson"), ("", "json"), ("text", "text")]
    assert spark.range(1).select(detect_language(F.lit("der Hund und die Katze über")), detect_language(F.lit("the cat and the dog")), detect_language(F.lit(""))).first()[:] == ("de", "en", "")


def test_ner_helpers(spark):
    text = "word " * 1000
    pieces = list(ner.chunks(text))
    assert pieces[0][0] == 0 and all(text[at : at + len(p)] == p for at, p in pieces) and pieces[-1][0] + len(pieces[-1][1]) == len(text)
    long = "word " * 40_000
    pieces = list(ner.chunks(long))
    assert len(pieces) > ner.MOST_CHUNKS and pieces[-1][0] + len(pieces[-1][1]) == len(long)
    assert len(list(ner.chunks(long, most=ner.MOST_CHUNKS))) == ner.MOST_CHUNKS and list(ner.chunks(long, most=0)) == []
    d = ner.Decoder()
    spans_ = ner.words("Dr. Anna Lee")
    assert ner.decode_spans({(2, 3, "person"): 3.0, (3, 3, "person"): 2.0, (0, 0, "age"): -9.0}, spans_, d) == [(4, 12, ner.sigmoid(3.0), "PERSON")]
    assert ner.trim_title("Dr. Anna", 0, 8) == 4 and ner.trim_title("Dr. no", 0, 6) == 0
    r = ner.model_recognizer("GLiNERPool", lambda: lambda t: [(0, 3, 0.9, "PERSON")], ("PERSON",))
    ner.verify([r])
    found = analyze(spark.createDataFrame([("Ann x",)], "text string"), registry=Registry([r])).first().findings
    assert found[0].recognizer == "GLiNERPool" and analyze(spark.createDataFrame([("Ann x",)], "text string"), registry=Registry([r]), config=AnalysisConfig(no_models=True)).first().findings == []
    got = spark.createDataFrame([("ID", "EUR 12,50"), ("PERSON", "MAX_VALUE"), ("PERSON", "Anna"), ("PERSON", "12:30 / 4"), ("AGE", "42"), ("ID", "12-4")], "e string, s string").select(rejected(F.col("e"), F.col("s"))).collect()
    assert [x[0] for x in got] == [True, True, False, True, False, False]


def test_evaluation_small(spark):
    gold = spark.createDataFrame([(1, 0, 4, "A"), (1, 5, 9, "B"), (2, 0, 3, "A")], "doc_id long, start long, end long, type string")
    pred = spark.createDataFrame([(1, 0, 4, "A", 0.9), (1, 3, 5, "B", 0.5)], "doc_id long, start long, end long, type string, score double")
    assert E.leak_rate(E.leaked(gold, pred)).first().leaked == 2
    s = E.strict(gold, pred).first()
    assert (s.tp, s.fp, s.fn) == (1, 1, 2)
    assert E.scored(gold, pred).count() == 2


def test_overlaps_against_brute_force(spark):
    """Ties at the edges, empty spans, nulls, keys of one side alone, equal rows."""
    import random

    rng = random.Random(5)
    pick = lambda top: None if rng.random() < 0.04 else rng.randrange(top)
    a, b = ([(pick(6), pick(30), pick(30), rng.choice(["A", "B", None])) for _ in range(300)] for _ in range(2))
    b = b[:60]
    frames = [spark.createDataFrame(x, "doc_id long, start long, end long, type string") for x in (a, b)]
    known = lambda *v: None not in v
    for keys, at in ((("doc_id",), (0,)), (("doc_id", "type"), (0, 3))):
        want = [(*x, any(known(*x[:3], *y[:3], *(x[i] for i in at)) and all(x[i] == y[i] for i in at) and x[1] < y[2] and x[2] > y[1] for y in b)) for x in a]
        got = [tuple(r) for r in E.overlapped(*frames, *keys).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and 50 < sum(x[4] for x in want) < 250


def test_evaluation_deals_out_by_the_size_of_its_sources(spark, monkeypatch):
    """Partitions grow with the input and no row meets another side's in a join; results stay."""
    import pathlib

    want = {name: QUERIES[name](spark, SF).collect() for name in ("eval_strict", "eval_rollup", "eval_precision_excl", "eval_partial", "eval_type_only")}
    stored = sum(f.stat().st_size for f in pathlib.Path(SF).glob("lineitem.parquet*"))
    monkeypatch.setattr(E, "STORED_BYTES", stored // 16)
    x = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert E.dealt(x, "l_orderkey").rdd.getNumPartitions() >= 16 and E.dealt(x.union(x), "l_orderkey").rdd.getNumPartitions() >= 32
    for name, rows in want.items():
        df = QUERIES[name](spark, SF)
        assert sorted(map(str, df.collect())) == sorted(map(str, rows))
        assert "SortMergeJoin [doc_id" not in df._jdf.queryExecution().sparkPlan().toString() and "ShuffledHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    assert E.dealt(spark.createDataFrame([(1,)], "doc_id long"), "doc_id").rdd.getNumPartitions() == 4
    monkeypatch.setattr(E, "STORED_BYTES", 1)
    assert E.dealt(x, "l_orderkey").rdd.getNumPartitions() == 200  # more would be sorted by the writers
    monkeypatch.setattr(E, "MOST_STORED_BYTES", stored // 300)
    assert E.dealt(x, "l_orderkey").rdd.getNumPartitions() >= 300


def test_sql_functions(spark):
    from maskloom.functions.sql import register

    register(spark, AnalysisConfig(entities=("EMAIL_ADDRESS",)))
    assert spark.sql("SELECT start, entity FROM pii_spans('x a@b.co', 'en')").first()[:] == (2, "EMAIL_ADDRESS")
    assert spark.sql("SELECT pii_redact('x a@b.co', 'en')").first()[0].endswith("<EMAIL_ADDRESS>")
