"""Full scores, gates, links, matching and classification on hand-built rows."""

import datetime as dt
import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from talus.functions import columns as X
from talus.operators import candidates, catalog, classify, fullscore, ingest, links, matching
from talus.sources import files
from talus.streaming import views


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_full_score_terms(spark):
    schema = "id int, gender string, form string, motor string, appearance string, waterproof int, noise int, price double, n_tags int"
    rows = [
        (1, "female", "a", "x", "hidden", 7, 40, 300.0, 9),
        (2, "male", "b", "y", "plain", 2, 66, 420.0, 0),
        (3, "unisex", "a", None, None, None, None, None, None),
    ]
    a = fullscore.Answers(gender="female", form="a", motor="x", appearance="hidden", waterproof=5, max_noise=45, budget=(200.0, 400.0))
    w = fullscore.PRESETS["female"]
    score, misses = fullscore.full_score(a, w, fullscore.HARD["female"], F.col("n_tags"), F.lit(0))
    got = {r.id: (r.s, r.m) for r in spark.createDataFrame(rows, schema).select("id", score.alias("s"), misses.alias("m")).collect()}
    assert got[1] == (32 + 38 + 24 + 24 + 14 + 20 + 18 + 6 + 4, 0)
    # -36 -14 -10 -22 -14, noise: 21 over in steps of 5 -> 5 * 4 = 20, budget: 8 + 1 * 4
    assert got[2] == (0, 6)
    # price counts as 0: 200 under the budget -> 8 + 4 * 4, cut at 20
    assert got[3] == (max(0, 14 + 38 - 10 - 22 + 2 + 2 - 20), 2)


def test_couples(spark):
    df = spark.createDataFrame([("male",), ("female",), ("unisex",), (None,)], "gender string")
    ask = lambda p: fullscore.Answers(gender="unisex", partner=p)
    gate = lambda a: [r.g for r in df.select(fullscore.gender_gate(F.col("gender"), a).alias("g")).collect()]
    assert gate(ask("male_male")) == [True, False, True, True] and gate(ask("mixed")) == [True] * 4
    assert gate(fullscore.Answers(gender="male")) == [True, False, True, False] and gate(fullscore.Answers()) == [True] * 4
    couple = [r.c for r in df.select(fullscore.for_couple(F.col("gender"), ask("mixed")).alias("c")).collect()]
    assert couple == [True, True, False, True]


def test_gates_take_unknown_features_for_missing(spark):
    df = spark.createDataFrame([(True, None), (None, True), (True, False), (True, True)], "must boolean, avoid boolean")
    ok = fullscore.gates(F.lit(True), [F.col("must")], [F.col("avoid")], F.lit(None).cast("string"), fullscore.Answers())
    assert [r.ok for r in df.select(ok.alias("ok")).collect()] == [True, False, True, False]


def test_link_patches(spark):
    shop, prefix = r"(?i)detail\.shop\.example/item\.htm", "https://detail.shop.example/item.htm?id="
    p = lambda a, b: one(spark, p=links.link_patch(F.lit(a).cast("string"), F.lit(b).cast("string"), shop, prefix)).p
    assert p(None, None) is None and p("", " ") is None
    assert tuple(p(None, "//detail.shop.example/item.htm?id=5&x=1")) == (prefix + "5", "filled")
    assert tuple(p("ask", "http://x.y/z")) == ("http://x.y/z", "replaced")
    assert tuple(p("//x.y/z", None)) == ("https://x.y/z", "canonical")
    assert p(prefix + "5", prefix + "6") is None and p(prefix + "5", None) is None and p("ask", None) is None


def test_duplicate_link_keys(spark):
    key = lambda u: one(spark, k=links.duplicate_link_key(F.lit(u).cast("string"), ("spm",), "shop.example$", "p:")).k
    assert key("HTTPS://A.B/C?spm=1#x") == "https://a.b/C" and key("https://a.b?q=1&spm=2&r=3") == "https://a.b/?q=1&r=3"
    assert key("http://m.shop.example/i?x=1&id=77") == "p:77" and key("http://m.shop.example/i?x=1") == "http://m.shop.example/i"
    assert key("No Link") == "no link" and key(None) == ""


def test_titles(spark):
    al = {"stick": ("口红",)}
    assert set(one(spark, t=matching.title_tokens(F.lit("Stick 小雪人 a"), al)).t) == {"stick", "口红", "小雪", "雪人", "小雪人", "stick 小雪人 a"}
    score = lambda a, b, s=0.0: one(spark, s=matching.title_score(F.lit(a), F.lit(b), matching.title_tokens(F.lit(a), {}), matching.title_tokens(F.lit(b), {}), F.lit(s))).s
    assert score("ab", "ab") == 1.0 and score("ab", "abcd") == 0.5 and score("", "x") == 0.0 and score("ab", "abcd", 0.86) == 0.86
    assert score("aa bb", "aa cc") == max(1 / 3, 0.72 / 3)


def test_current_link_stays(spark):
    df = spark.createDataFrame([("a", "x", 0.9, False), ("a", "y", 0.5, True), ("b", "x", 0.4, True), ("b", "z", 0.6, False), ("c", "x", 0.1, True)], "t string, c string, score double, cur boolean")
    got = {r.t: (r.match, r.kept) for r in matching.best_or_current(df, "t", "c", F.col("cur"), 0.42).collect()}
    assert got == {"a": ("y", True), "b": ("z", False)}


def test_ambiguity(spark):
    df = spark.createDataFrame([(1, "a", 30, "name"), (1, "b", 27, "token"), (2, "a", 100, "alias"), (2, "b", 99, "name"), (3, "a", 24, "name"), (4, "a", 30, "name"), (4, "b", 26, "token")], "id int, c string, score int, matched_by string")
    got = {r.id: r.c for r in matching.unambiguous(df, "id", "c", 25, 4).collect()}
    assert got == {2: "a", 4: "a"}


def test_mergeable_groups(spark):
    rows = [(1, "abcdefgh", ""), (1, "abcdef", ""), (2, "abcdefgh", "zeta"), (2, "xyz", "zeta"), (3, "abcdefgh", "zeta"), (3, "xyz", ""), (4, "abc", "q"), (5, "", "z"), (5, "abc", "z"), (6, "same", ""), (6, "same", "")]
    got = {r.g: (r.n, r.mergeable) for r in matching.mergeable_groups(spark.createDataFrame(rows, "g int, k string, a string"), ["g"], "k", "a").collect()}
    assert got == {1: (2, True), 2: (2, True), 3: (2, False), 6: (2, True)}


def test_word_edges_are_ascii(spark):
    text = F.lit("sesesó ciónesez AP\u0130 KEY é12345é thé éthe")
    rules = [("edge", r"[a-z]{3}es\b", "", 2), ("inner", r"\bthe\b", "", 3), ("dotted", r"api key", "", 5), ("escaped", r"\\b", "", 7), ("negative", "key", r"\b12345\b", 11)]
    flags, score = fullscore.families(text, rules)
    r = one(spark, f=flags, s=score)
    assert r.f.asDict() == {"edge": True, "inner": True, "dotted": True, "escaped": False, "negative": False} and r.s == 10
    r = one(spark, n=fullscore.first_number(text, (r"\b(\d{5})\b",)), c=candidates.contaminant(F.lit("éspamé"), patterns=(r"\bspam\b",)), d=ingest.display_name(F.lit("éNEWé lamp"), F.lit(""), r"\bnew\b"))
    assert (r.n, r.c, r.d) == (12345, True, "é é lamp")
    assert one(spark, k=catalog.series_key(F.lit("éNEWé lamp"), F.lit(""), r"\bnew\b")).k == "é é lamp"


def test_token_recall_against_contains(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcé1", k=rng.randint(1, 7)))
    texts = [(i, " ".join(word() for _ in range(30))) for i in range(60)] + [(90, None), (91, ""), (92, "ABC小雪人b")]
    items = [(i, sorted({"".join(rng.choices("abc1", k=rng.randint(3, 4))) for _ in range(6)})) for i in range(12)] + [(50, ["小雪", "abc"]), (51, [])]
    d, q = spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(items, "i int, k array<string>")
    got = {r.i: (round(r.best, 9), r.n_match, r.n_mismatch) for r in matching.token_recall(q, "i", "k", d, "d", "t").collect()}
    want = {}
    for i, k in items:
        if k:
            s = [sum(x in (t or "").lower() for x in k) / len(k) for _, t in texts]
            want[i] = (round(max(s), 9), sum(x >= 0.9 for x in s), sum(x < 0.2 for x in s))
    assert got == want


def test_token_recall_counts_every_text(spark, monkeypatch):
    """Repeated and missing ids are texts of their own; blocks of items, forgotten runs and long ones change nothing."""
    texts = [(1, "abc xyz1"), (1, "abc"), (1, "xyz1 noth"), (None, "abc xyz1"), (None, None), (2, "d\u0130e " + "q" * 80 + "xyz1" + "q" * 80), (3, "小雪人é小")]
    items = [("a", ["abc", "xyz1"]), ("b", ["die", "xyz1", "no-run"]), ("c", ["雪人", "人é"]), ("d", ["none"]), ("e", []), (None, ["abc"])]
    d, q = spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(items, "i string, k array<string>")
    want = {"a": (1.0, 2, 3 - 1), "b": (2 / 3, 0, 7 - 4), "c": (0.5, 0, 6), "d": (0.0, 0, 7), None: (1.0, 3, 4)}
    for size in (8 << 20, 30):
        assert {r.i: (r.best, r.n_match, r.n_mismatch) for r in matching.token_recall(q, "i", "k", d, "d", "t", size).collect()} == want
    for name, n in (("KNOWN", 1), ("LONGEST", 3), ("SCORES", 8)):
        monkeypatch.setattr(matching, name, n)
    fold = matching.recalls([["abc", "xyz1"], ["die", "xyz1"], ["雪人"]], [2, 3, 2])
    low = pa.table({"text": [(t or "").replace("\u0130", "i") for _, t in texts]}).to_batches(max_chunksize=3)
    assert pa.Table.from_batches(fold(iter(low))).to_pydict() == {"item": [0, 1, 2], "best": [1.0, 2 / 3, 0.5], "n_match": [2, 0, 0], "n_some": [5, 4, 1]}
    assert pa.Table.from_batches(fold(iter([]))).num_rows == 0


def test_safe_patches_and_subtypes(spark):
    kids = {"a": ("x",), "b": ("y",)}
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), (None, "x")], "p string, c string")
    assert [r.u for r in df.select(classify.under(F.col("p"), F.col("c"), kids).alias("u")).collect()] == ["x", None, None, None]
    safe = lambda old, new, risk, ev: one(spark, s=classify.safe_patch(tuple(F.lit(x).cast("string") for x in old), tuple(F.lit(x).cast("string") for x in new), F.lit(risk), F.lit(ev), ("a",), ("bad",))).s
    assert safe((None, None), ("a", None), "fine", "text") is True and safe(("a", None), ("a", None), "fine", "text") is False
    assert safe((None, None), ("b", None), "fine", "text") is False and safe((None, None), ("a", None), "bad", "text") is False and safe((None, None), ("a", None), "fine", " ") is False


def test_descriptions(spark):
    d = lambda h: one(spark, d=classify.description(F.lit(h).cast("string"))).d
    long = "A description that is long enough. "
    assert d(None) is None and d("<p>short</p>") is None
    assert tuple(d(f'<meta name="description" content="{long}"><p>{long}</p>')) == (long.strip(), "meta", 0.95)
    assert d(f"<p>no</p><p>{long * 40}</p>").text == (long * 40)[:600] and d(f"<title>{long}</title>").source == "title"


def test_untested_helpers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "price int, name string")
    files.write_buffer(rows, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).collect()[0].name == "x"
    assert one(spark, c=candidates.contaminant(F.lit("Nice"), F.lit("BAD thing"), patterns=("bad", "worse"))).c is True
    assert candidates.valid_choice("x", ["y"]) == "all" and candidates.valid_choice("y", ["y"]) == "y"
    assert one(spark, n=catalog.recovered_name(F.lit("untitled"), F.lit(None).cast("string"), F.lit("real"))).n == "real"
    assert one(spark, p=X.first_price(F.lit("from 1,299.50 to 3"))).p == 1299.5 and one(spark, p=X.first_price(F.lit("none"))).p is None
    assert tuple(one(spark, **{f"c{i}": c for i, c in enumerate(ingest.specs({"a": F.lit(None).cast("int")}, {"a": F.lit(3), "b": F.lit(4)}))})) == (3, 4)
    p = candidates.Preferences(excluded_kinds=("a",))
    assert [r.h for r in spark.createDataFrame([("a",), ("b",), (None,)], "k string").select(candidates.hard_ok(F.col("k"), p).alias("h")).collect()] == [False, True, True]
    t = dt.datetime(2024, 1, 1)
    old, new = ([(1, "a", t), (2, "b", t)], [(1, "c", t + dt.timedelta(hours=1))])
    got = files.upsert_latest(*(spark.createDataFrame(r, "k int, v string, ts timestamp") for r in (old, new)), ["k"], "ts")
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "c"), (2, "b")]
    assert sorted(r.n for r in views.windowed_counts(spark.createDataFrame([("a", t), ("a", t), ("b", t)], "k string, ts timestamp"), "ts", "k", "1 hour", "1 hour").collect()) == [1, 2]


def test_one_malformed_buffer_entry_is_dropped_alone(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"name": "a"}, 5, "text", {"name": "b", "price": 2}, None]))
    (tmp_path / "y.json").write_text('[{"name": "broken')
    assert sorted(r.name for r in files.read_buffer(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_append_to_a_new_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, x string")
    files.append_new(spark, rows, str(tmp_path / "n"), ["id"])
    files.append_events(rows, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 5
    assert files.content_version(rows.limit(0)) == ""


def test_merge_of_two_sources_as_a_loop(spark):
    """Against items applied one by one: blanks filled first come first served, inserts no targets of each other."""
    import random

    from talus.operators.matching import merge_two_sources

    r = random.Random(4)
    blank = lambda v: v is None or (isinstance(v, str) and not v.strip())
    fields = ["brand", "note", "price"]

    def row(pos):
        return (pos, r.choice([None, "", "a", "b", "c"]), r.choice([" X", "x ", "y", "", None, "z"]), r.choice(["B", "b", " ", None, "c"]), r.choice([None, " ", "n1", "n2"]), r.choice([None, 0.0, 1.5]))

    def key(x):
        name, brand = ((x[k] or "").strip().lower() for k in (2, 3))
        return (name, brand) if name and brand else None

    schema = "pos int, oid string, name string, brand string, note string, price double"
    for _ in range(6):
        targets, items = [row(i) for i in range(12)], [row(i) for i in range(25)]
        rows, by_id, by_name, counts = [list(t) for t in targets], {}, {}, [0, 0, 0, 0]
        for k, t in enumerate(targets):
            if t[1]:
                by_id[t[1]] = k
            if key(t):
                by_name[key(t)] = k
        for i in items:
            at = by_id.get(i[1]) if i[1] else None
            how = 0 if at is not None else 1
            at = at if at is not None else by_name.get(key(i))
            if at is None:
                rows.append(list(i))
                counts[2] += 1
                continue
            counts[how] += 1
            for f in (3, 4, 5):
                if blank(rows[at][f]) and not blank(i[f]):
                    rows[at][f] = i[f]
                    counts[3] += 1
        got = merge_two_sources(spark.createDataFrame(targets, schema), spark.createDataFrame(items, schema), "oid", "name", "brand", "pos", fields).collect()
        found = [[x[c] for c in ("pos", "oid", "name", "brand", "note", "price")] for x in got]
        assert sorted(map(repr, found)) == sorted(map(repr, rows))
        assert [sum(x.by_key for x in got), sum(x.by_name for x in got), sum(x.origin == "insert" for x in got), sum(x.filled for x in got)] == counts
