import json


from hourlens import schemas
from hourlens.operators import names as N
from hourlens.sources.dictionaries import load_aliases, load_dictionary, nested_aliases, save_aliases
from tests.conftest import ask, rows


def values(spark, *pairs):
    return spark.createDataFrame(list(pairs), "entity_type STRING, value STRING")


def test_normalize(spark, aliases):
    df = values(spark, ("employee", "张经理"), ("employee", "MANAGER ZHANG "), ("employee", "Nobody"), ("x", "Li Si"))
    got = {r.value: r.normalized for r in N.normalize_names(df, aliases).collect()}
    assert got == {"张经理": "李四", "MANAGER ZHANG ": "张三", "Nobody": "Nobody", "Li Si": "Li Si"}


def test_variations_and_collisions(spark, aliases):
    got = {r.canonical: r.variations for r in N.alias_variations(aliases).collect()}
    assert got["张三"] == ["张三", "Zhang San", "张经理", "Manager Zhang"]
    assert rows(N.alias_collisions(aliases), "entity_type", "alias", "owners") == [("employee", "张经理", 2)]
    mentions = spark.createDataFrame([("employee", "Nobody")], "entity_type STRING, normalized STRING")
    assert N.with_variations(mentions, aliases).first().variations == ["Nobody"]
    stats = N.alias_stats(aliases).first()
    assert tuple(stats) == (2, 3, 7)


def test_fuzzy(spark, aliases):
    def best(text, threshold):
        r = N.fuzzy_canonical(values(spark, ("employee", text)), aliases, threshold).first()
        return r.canonical, r.score

    assert best("Zhang", 0.5) == ("张三", 5 / 9)
    assert best("Z", 0.8) == (None, None)
    assert best("zhang san", 0.8) == ("张三", 1.0)
    assert best("Zhang San jr", 0.7) == ("张三", 9 / 12)


def test_containment_pairs_equal_brute_force(spark):
    left = ["ab", "abc", "b", "xabcx", "zz"]
    right = ["abc", "a", "bc", "zzz", "q"]
    pairs = N.containment_pairs(
        spark.createDataFrame([(x,) for x in left], "l STRING"), "l",
        spark.createDataFrame([(x,) for x in right], "r STRING"), "r", [])
    assert rows(pairs, "l", "r") == sorted((a, b) for a in left for b in right if a in b or b in a)


def test_rows_containing_equals_like(spark, small_star):
    asked = ["stone", "S", "AS", "robin vale", "%", "nobody"]
    got = rows(N.rows_containing(spark.createDataFrame([(x,) for x in asked], "v STRING"), "v",
                                 small_star.employee, "uuid", ["name", "alias"]), "v", "uuid")
    people = [(r.uuid, r.name, r.alias) for r in small_star.employee.collect()]
    want = sorted((v, u) for v in asked for u, n, a in people if v.lower() in n.lower() or v.lower() in (a or "").lower())
    assert got == want


def test_upsert_and_remove(spark, aliases):
    new = spark.createDataFrame([("employee", "张三", "Zhang San"), ("employee", "张三", "Old Zhang"), ("employee", "王五", "Wang")],
                                "entity_type STRING, canonical STRING, alias STRING")
    after = N.alias_upsert(aliases, new)
    assert rows(after.where("added"), "canonical", "canonical_seq", "alias", "alias_seq") == [
        ("张三", 0, "Old Zhang", 3), ("王五", 2, "Wang", 0)]
    gone = spark.createDataFrame([("employee", "李四", "张经理"), ("employee", "李四", "Li Si")],
                                 "entity_type STRING, canonical STRING, alias STRING")
    left = N.alias_remove(aliases, gone)
    # The other owner of the spelling takes over, and the bare canonical stays.
    got = {r.value: r.normalized for r in N.normalize_names(values(spark, ("employee", "张经理"), ("employee", "李四")), left).collect()}
    assert got == {"张经理": "张三", "李四": "李四"}


def test_search(aliases):
    got = [tuple(r) for r in N.alias_search(aliases, "Zhang San").collect()]
    assert got == [("employee", "张三", 1, 1)]
    assert [r.canonical for r in N.alias_search(aliases, "zhang", "department").collect()] == []


def test_dictionary_hits_at_edges(spark, dictionary):
    log = ask(spark, "Sales, (HR) and sales-people; Marketings; C++ and Mobile  App")
    more = dictionary.union(spark.createDataFrame([("tool", "C++"), ("tool", "C")], schemas.DICTIONARY))
    hits = N.dictionary_hits(log, N.known_names(more))
    assert rows(hits, "start", "value") == [(0, "Sales"), (16, "sales"), (42, "C++"), (8, "HR")]


def test_empty_dictionary(spark, dictionary):
    none = dictionary.where("false")
    assert N.dictionary_hits(ask(spark, "Sales"), N.known_names(none)).count() == 0


def test_partial_chinese(spark):
    names = spark.createDataFrame([("department", "财务管理中心"), ("employee", "张三")], schemas.DICTIONARY)
    got = N.partial_chinese_matches(ask(spark, "财务 hours", "张三丰 and 中"), N.known_names(names))
    assert rows(got, "question_id", "entity") == [(0, "财务管理中心"), (1, "张三")]


def test_files(spark, aliases, tmp_path):
    one, two, three = (tmp_path / n for n in ("a.json", "b.json", "c.json"))
    one.write_text(json.dumps({"department": ["HR", "HR", "Sales"]}))
    two.write_text(json.dumps({"department": ["HR"], "project": ["Mobile App"]}))
    got = rows(load_dictionary(spark, str(one), str(two)), "entity_type", "entity")
    assert got == [("department", "HR"), ("department", "Sales"), ("project", "Mobile App")]
    nested = {"employee": {"B": ["b1", "b2"], "A": []}}
    three.write_text(json.dumps(nested))
    loaded = load_aliases(spark, str(three))
    assert rows(loaded, "canonical", "canonical_seq", "alias", "alias_seq") == [("A", 1, None, None), ("B", 0, "b1", 0), ("B", 0, "b2", 1)]
    assert json.loads(nested_aliases(loaded).first().aliases) == nested["employee"]
    save_aliases(aliases, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == aliases.count()


def test_runs_do_not_carry_their_text(spark):
    """A text of 20,000 words with two names, one with signs around it; and the size of what is joined."""
    names = spark.createDataFrame([("project", "(Big) Plan!"), ("employee", "Alex Stone")], schemas.DICTIONARY)
    long = " ".join(["word"] * 10_000) + " alex STONE (big) plan! " + " ".join(["more"] * 10_000) + " (Big) Plan"
    log = spark.createDataFrame([(1, long)], "question_id BIGINT, text STRING")
    known = N.known_names(names)
    got = rows(N.dictionary_hits(log, known), "entity_type", "value", "start", "end")
    at = long.index("alex")
    assert got == [("employee", "alex STONE", at, at + 10), ("project", "(big) plan!", at + 11, at + 22)]


def brute_hits(texts, names):
    """Every name at every place of every text: words whole, ignoring case; Chinese names anywhere."""
    import re

    out = []
    for i, text in texts:
        low = text.lower()
        for kind, name in names:
            bare = re.sub(r"^\W+|\W+$", "", name)
            lead = name.index(bare)
            chinese = "一" <= bare[0] <= "龥"
            for at in range(len(text)):
                end = at + len(name)
                inner = (at + lead, at + lead + len(bare))
                whole = chinese or (not re.match(r"\w", text[inner[0] - 1:inner[0]]) and not re.match(r"\w", text[inner[1]:inner[1] + 1]))
                if low[at:end] == name.lower() and whole:
                    out.append((i, at, end, kind, text[at:end]))
    return sorted(out)


def test_dictionary_hits_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    vocabulary = ["plan", "Big", "alex", "stone", "x1", "The", "of", "财务", "中心", "三大厦"]
    glue = [" ", " ", " ", "-", ", ", "  ", ""]
    phrase = lambda n: "".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(n)).strip(" ,-")
    names = sorted({("t", phrase(n)) for n in (1, 1, 2, 2, 3, 4, 7, 8, 9, 9, 12, 20) for _ in range(4)} | {
        ("u", "(((((Big plan"), ("u", "alex stone!!!!!!"), ("u", "财务中心三大厦财务中心三大厦")})
    texts = [(i, phrase(rng.randint(0, 30))) for i in range(60)]
    texts += [(100 + i, f"{phrase(3)} {name.upper()} {phrase(2)}") for i, (_, name) in enumerate(names)]
    texts += [(200, ""), (201, "(((((big PLAN alex STONE!!!!!!"), (202, "alex stone!!!!!")]
    log = spark.createDataFrame(texts, "question_id BIGINT, text STRING")
    known = spark.createDataFrame(names, schemas.DICTIONARY)
    found = N.dictionary_hits(log, N.known_names(known)).select("question_id", "start", "end", "entity_type", "value")
    got = sorted(map(tuple, found.collect()))
    assert got == [h for h in brute_hits(texts, names)] and len(got) > 100


def test_one_long_name_changes_nothing(spark):
    """A name of 10,000 words is found, and no row gets longer for it."""
    long = " ".join(f"w{i}" for i in range(10_000))
    names = [("project", long), ("project", "w0 w1"), ("employee", "w9998")]
    texts = [(1, f"see {long.upper()} now"), (2, " ".join(f"w{i}" for i in range(9_999))), (3, f"{long}x")]
    log = spark.createDataFrame(texts, "question_id BIGINT, text STRING")
    known = N.known_names(spark.createDataFrame(names, schemas.DICTIONARY))
    found = N.dictionary_hits(log, known)
    assert rows(found.where("length(value) > 9"), "question_id", "start", "end") == [(1, 4, 4 + len(long))]
    assert rows(found.where("length(value) <= 9"), "question_id", "value") == [
        (1, "W0 W1"), (1, "W9998"), (2, "w0 w1"), (2, "w9998"), (3, "w0 w1"), (3, "w9998")]
    assert max(len(r.piece) for r in N.name_index(known).collect()) < 30


def test_containing_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(12)
    piece = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts = [(i, rng.choice("xy"), piece(rng.randint(0, 14))) for i in range(80)] + [(900, "x", None), (901, "x", "")]
    needles = [(rng.choice("xy"), piece(rng.randint(0, 6))) for _ in range(60)] + [("x", None), ("x", "")]
    for ratio in (0.0, 0.5):
        got = N.containing_pairs(spark.createDataFrame(needles, "t STRING, n STRING").distinct(), "n",
                                 spark.createDataFrame(texts, "id INT, t STRING, text STRING"), "text", ["t"], ratio)
        want = sorted({(n, i) for t, n in needles for i, u, x in texts if n and x and t == u and n in x and len(n) >= ratio * len(x)})
        assert rows(got, "n", "id") == sorted(want, key=str) and len(want) > 10


def test_a_long_name_costs_its_length(spark):
    """A name of 10,000 characters: linear in pieces, found by what it contains and in what contains it."""
    import random

    rng = random.Random(13)
    long = "".join(rng.choice("abcdefgh") for _ in range(10_000))
    left = spark.createDataFrame([(long,), (long[40:90],), ("zzz",)], "l STRING")
    right = spark.createDataFrame([(long[50:80],), (f"x{long}y",), ("q",)], "r STRING")
    got = N.containment_pairs(left, "l", right, "r", [])
    assert {(len(r.l), len(r.r)) for r in got.collect()} == {(10_000, 30), (50, 30), (10_000, 10_002), (50, 10_002)}


def test_pieces_are_neither_sorted_nor_gathered(spark):
    """One task's memory holds needles or texts, not all their pieces: no sort by needle, no hash of every piece of a text."""
    needles = spark.createDataFrame([("alpha",), ("beta",)], "n STRING")
    texts = spark.createDataFrame([("alphabet",), ("alphabet",), ("abet a beta",)], "text STRING")
    found = N.containing_pairs(needles, "n", texts, "text", [])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert not [line for line in plan.splitlines() if "Aggregate(keys=[_" in line and "_gram" in line]
    assert rows(found, "n", "text") == [("alpha", "alphabet"), ("beta", "abet a beta")]
