"""Edge cases of fields, prices, series, reasons and favourites."""

from pyspark.sql import functions as F

from talus.functions import columns as X
from talus.operators import candidates as N
from talus.operators import catalog as K
from talus.operators import ranking as R


def test_filled_by_type(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, ' ', array(), map(), '{}', NULL), (2, 'x', array(NULL), map('a', NULL), '{"a": null}', 0.0), (3, NULL, NULL, NULL, NULL, 1.0), (4, '\\t', array(1), map('a', 1), '[]', NULL),
        (5, 'y', array(1), map('b', 2), '" "', 1.0), (6, 'y', array(1), map('b', 2), '0', 1.0), (7, 'y', array(1), map('b', 2), 'null', 1.0) AS t(id, s, a, m, j, d)"""
    ).withColumn("j", F.parse_json("j"))
    kinds = dict(df.dtypes)
    got = df.select("id", *[X.is_filled(F.col(c), kinds[c]).alias(c) for c in "samjd"]).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [
        (False, False, False, False, False), (True, True, True, True, True), (False, False, False, False, True), (False, True, True, False, False), (True, True, True, False, True),
        (True, True, True, True, True), (True, True, True, False, True),
    ]
    assert [(r.id, r.missing) for r in K.incomplete(df, ["s", "a", "d"]).orderBy("id").collect()] == [(1, ["s", "a", "d"]), (3, ["s", "a"]), (4, ["s", "d"])]


def test_prices_by_currency(spark):
    rows = [(1000.0, "eur"), (1000.0, "USD"), (999.0, "EUR"), (1000.5, "EUR"), (0.0, "EUR"), (-5.0, None), (None, "EUR"), (float("nan"), "EUR"), (float("inf"), "EUR"), (7.0, None)]
    got = spark.createDataFrame(rows, "p double, c string").select(X.positive_price(F.col("p"), F.col("c")).alias("x")).collect()
    assert [r.x for r in got] == [10.0, 1000.0, 999.0, 1000.5, None, None, None, None, None, 7.0]


def test_series_and_their_rows(spark):
    rows = [
        (1, "NEW Rose-Set", "u", None, "", ["b", "a"]), (2, "rose set", "u", 5, " ", None), (3, "", "https://x.example/products/rose%20set?v=1#q", 2, "n", ["c", "b"]), (4, None, "https://x.example/p/9?q", 1, "m", []),
        (5, " ", " ", 1, "z", None), (6, "Rosé", None, 1, None, ["é"]),
    ]
    df = spark.createDataFrame(rows, "id int, name string, url string, pos int, note string, hints array<string>")
    keyed = df.withColumn("series", K.series_key(F.col("name"), F.col("url"), r"\bnew\b"))
    got = {r.series: (r.pos, r.note, r.hints) for r in K.collapse_series(keyed, "series", "pos", "id", ["note"], "hints").collect()}
    assert got == {"rose set": (2, "n", ["c", "b", "a"]), "https://x.example/p/9": (1, "m", []), "rosé": (1, None, ["é"])}


def test_reasons(spark):
    df = spark.createDataFrame([(["b", "a", None, "", "b", "c"],), ([],), (None,), (["a"],)], "l array<string>")
    weight = lambda line, i: F.when(line == "c", 5).when(line == "z", 9).otherwise(1)
    got = [r.x for r in df.select(R.primary_reason(F.col("l"), weight, F.lit("none")).alias("x")).collect()]
    assert got == ["c, b", "none", "none", "a"]


def test_origin_and_favourites(spark):
    df = spark.createDataFrame([(1, None, "b", True), (2, 9, "a", False), (3, None, None, None), (4, 1, "b", None), (5, None, "", True)], "id int, original int, brand string, home boolean")
    liked = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int")
    assert sorted(r.id for r in N.only_favourites(df, F.coalesce("original", "id"), liked, "k").collect()) == [1, 2, 4]
    assert [[(r.place, r.brand) for r in N.brand_options(df, "brand", "home", o).collect()] for o in ("all", "domestic", "foreign")] == [[(1, "a"), (2, "b")], [(1, "b")], [(1, "a")]]
