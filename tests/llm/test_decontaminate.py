from pyspark.sql import functions as F

from rootspan.llm import decontaminate

ITEM = "A train leaves with 40 people and Anna Berg at noon. It stops for 3 hours, then Anna Berg counts 40 seats in the last coach of the train."


def leaks(spark, docs, items, **k):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, words string, hash int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(((r.doc_id, r.item_id, r.n_slots, r.n_changed) for r in decontaminate.find_leaks(d, b, **k).collect()), key=str), d, b


def test_template(spark):
    df = spark.createDataFrame([("He met John Smith, 1,000.5 km away! It was 3rd. NO... (x-ray) Été à Paris 5kg",)], "text string")
    words = df.select(decontaminate.template(F.col("text")).alias("w"), decontaminate.slots(F.col("text"), decontaminate.template(F.col("text"))).alias("s")).first()
    assert words.w == ["he", "met", "@", "#", "%", "away", "it", "was", "#rd", "no", "x", "ray", "@", "à", "@", "#kg"]
    assert sorted((s.pos, s.kind, s.value) for s in words.s) == [(2, "@", "john smith"), (3, "#", "1 000.5"), (4, "%", "km"), (8, "#", "3"), (12, "@", "été"), (14, "@", "paris"), (15, "#", "5")]


def test_copies_and_new_parameters(spark):
    padded = "Some words stand before it, and many at that. " + ITEM + " And some follow."
    other = padded.replace("40", "70").replace("Anna Berg", "Otto").replace("3 hours", "9 days")
    broken = padded.replace("40 people", "70 people").replace("40 seats", "71 seats")
    part = "Before. " + ITEM.split(". ")[1] + " After."
    short = "Before. It stops for 3 hours then. After it goes on to some other place, as ever."
    docs = [(1, padded), (2, padded.upper().lower()), (3, other), (4, broken), (5, part), (6, short), (7, None), (8, ""), (9, "word " * 20000 + ITEM), (None, padded), (1, padded)]
    got, d, b = leaks(spark, docs, [(10, ITEM), (11, None), (12, ""), (13, "one two"), (None, "zzz")])
    found = {(doc, item) for doc, item, _, _ in got}
    assert found == {(1, 10), (3, 10), (5, 10), (9, 10), (None, 10)} | ({(2, 10)} & found)
    by = {g[0]: g[2:] for g in got}
    assert by[1] == (6, 0) and by[3][0] == 6 and by[3][1] >= 5
    kept = {(r.doc_id) for r in decontaminate.without_leaks(d, b).collect()}
    assert kept == {4, 6, 7, 8} | ({2} - {g[0] for g in got})
    sharded, _, _ = leaks(spark, docs, [(10, ITEM), (13, "one two")], broadcast_rows=3)
    assert sharded == got


def test_short_items(spark):
    got, _, _ = leaks(spark, [(1, "so one two three it is"), (2, "one two"), (3, "x")], [(5, "One, two!"), (6, "x")])
    assert [g[:2] for g in got] == [(1, 5), (2, 5), (3, 6)]


def test_empty(spark):
    assert leaks(spark, [], [(1, "a")])[0] == []
    assert leaks(spark, [(1, "a")], [])[0] == []
    _, d, b = leaks(spark, [(1, "a")], [(1, None)])
    assert decontaminate.without_leaks(d, b).count() == 1


def test_copies_in_another_case_and_with_one_value_broken(spark):
    one = ITEM.replace("40 seats", "71 seats")
    gap = ITEM.replace("leaves with 40 people", "leaves at 6 with 12 people")
    copies = [ITEM.lower(), ITEM.upper(), ITEM.title(), one, ITEM.split(". ")[1].upper()]
    others = [ITEM.replace("40 people", "70 people").replace("40 seats", "71 seats"), "It stops for 3 hours, then Anna left.", gap.split(". ")[0]]
    got, d, b = leaks(spark, [(i, "Before it. " + t + " After it.") for i, t in enumerate(copies + others)], [(10, ITEM)])
    assert {g[0] for g in got} == set(range(len(copies)))
    assert {r.doc_id for r in decontaminate.without_leaks(d, b).collect()} == set(range(len(copies), len(copies + others)))


def test_document_in_another_case_is_found(spark):
    padded = "Some words stand before it, and many at that. " + ITEM + " And some follow."
    assert [g[:2] for g in leaks(spark, [(2, padded.upper().lower())], [(10, ITEM)])[0]] == [(2, 10)]


def test_long_runs_of_names_and_numbers(spark):
    runs = ["He met " + run * 20_000 + ". Before it. " + ITEM + " After it." for run in ("Word ", "12 ", "12.5 kg ", ". ")]
    got, d, b = leaks(spark, list(enumerate(runs)), [(10, ITEM)])
    assert [g[:2] for g in got] == [(i, 10) for i in range(4)]
    run = F.lit("".join(runs[:2]))
    kinds = spark.range(1).select(F.regexp_extract_all(run, F.lit(f"({decontaminate.NUMBER})"), 1).alias("n"), F.regexp_extract_all(decontaminate.marked(run), F.lit(decontaminate.NAME), 2).alias("v")).first()
    assert max(map(len, kinds.n)) == 3 * 20_000 and max(map(len, kinds.v)) == 5 * 20_000


def test_sieve_lets_known_hashes_and_few_others_through(spark):
    known = spark.range(20_000).selectExpr("xxhash64(id) as hash")
    found = {r.id for r in decontaminate.sieved(spark.range(60_000).selectExpr("id", "xxhash64(id) as hash"), known).collect()}
    assert found >= set(range(20_000)) and len(found) < 20_010


def test_equal_items_meet_documents_once(spark):
    one, other = "It stops for 3 hours, then Anna Berg counts.", "The last coach of the train stays empty at noon."
    items = [(1, ITEM), (2, ITEM), (None, ITEM), (None, ITEM), (3, one), (3, other), (4, other), (4, one), (5, one), (6, None), (7, "")]
    got, d, b = leaks(spark, [(1, ITEM), (2, f"So. {one} And. {other} It is."), (None, ITEM)], items)
    first, members = decontaminate.one_of_equals(b)
    assert first.where("text <> ''").count() == 4 and members.count() == 8
    assert {g[:2] for g in got} >= {(i, j) for i in (1, None) for j in (1, 2, None)} | {(2, 3), (2, 4), (2, 5)}
    assert decontaminate.without_leaks(d, b).count() == 0
