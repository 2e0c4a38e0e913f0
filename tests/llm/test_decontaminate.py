import random

import pytest

from hourlens.llm import decontaminate
from hourlens.llm.decontaminate import Settings, clean, matches, template

from .conftest import prose

ITEM = "Tom buys 12 apples at 3 dollars each and gives 12 to Anna Bell. How many kg does a 5 kg box with 3 bags hold?"


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(11)
    rows = [(0, ITEM), (1, prose(rng, 30).capitalize() + "."), (2, None), (3, ""), (4, "too short")]
    return spark.createDataFrame(rows, "item_id long, text string"), rows[1][1]


def found(docs, benchmark):
    return {(r.doc_id, r.item_id): r for r in matches(docs, benchmark).collect()}


def test_finds_items_and_their_variants(spark, benchmark):
    table, other = benchmark
    rng = random.Random(12)

    def around(text):
        return prose(rng, 50) + " " + text + " " + prose(rng, 70)

    changed = ITEM.replace("12", "17").replace("3", "4").replace("Tom", "Kim").replace("Anna Bell", "Zoe").replace(
        "dollars", "euros")
    odd = changed.replace("gives 17", "gives 29")  # one value of the item, two of the document
    docs = [(1, around(ITEM)), (2, around(changed)), (3, around(ITEM.lower().replace("tom", "Tom"))), (4, around(other)),
            (5, prose(rng, 500)), (6, around(" ".join(ITEM.split()[:10]))), (7, None), (8, ""), (9, "one. " + other),
            (10, around(odd)), (11, around(ITEM) + " " + around(other)), (12, "too short")]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), table)
    assert {k for k in got} >= {(1, 0), (2, 0), (4, 1), (9, 1), (11, 0), (11, 1), (12, 4)}
    assert not {k for k in got} & {(5, 0), (5, 1), (6, 0), (10, 0)}
    assert not got[1, 0].changed and got[2, 0].changed and got[1, 0].share == 1
    assert {k[0] for k in got} <= {1, 2, 3, 4, 9, 11, 12}


def test_equals_looking_at_all_windows(spark):
    """Against a plain search for runs of five words, on texts without numbers and capitals."""
    rng = random.Random(13)
    items = [(i, prose(rng, rng.randint(8, 40))) for i in range(15)]
    docs = []
    for i in range(120):
        words = prose(rng, rng.randint(0, 60)).split()
        if i % 2:
            part = rng.choice(items)[1].split()
            cut = rng.randint(0, len(part) // 3)
            words[len(words) // 2:len(words) // 2] = part[cut:]
        docs.append((i, " ".join(words)))
    runs = lambda t: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)}
    want = {(d, i) for d, t in docs for i, x in items if len(runs(x) & runs(t)) >= 0.8 * len(runs(x))}
    got = found(spark.createDataFrame(docs, "doc_id long, text string"),
                spark.createDataFrame(items, "item_id long, text string"))
    assert set(got) == want and 10 < len(want) < 60


def test_template():
    known = decontaminate._Words()
    a = template("It costs 5kg, says Mr John Smith.", known)
    b = template("it costs 77 km, says Ms Doe.", known)
    assert a.kinds.tolist() == b.kinds.tolist() == [2, 0, 1, 4, 0, 2]
    assert (a.values == b.values).all()
    assert a.slots(0, 9) == ["2:it", "1:5", "4:kg", "2:mr john smith"]


def test_odd_rows(odd, none, benchmark):
    table, _ = benchmark
    assert matches(odd, table).collect() == []
    assert clean(odd, table).columns == odd.columns and clean(odd, table).count() == odd.count()
    assert matches(none, table).collect() == [] and matches(odd, table.limit(0)).collect() == []


def test_clean_drops_rows_by_text(spark, benchmark):
    table, other = benchmark
    docs = spark.createDataFrame([(1, other), (1, "another text"), (None, other), (None, "no id")], "doc_id long, text string")
    assert sorted(r.text for r in clean(docs, table, Settings()).collect()) == ["another text", "no id"]


FARM = "A farm has 14 cows and 9 goats. Tom sells 3 cows. Anna buys 2 goats. How many animals are on the farm?"


def test_finds_names_at_sentence_starts_and_lost_capitals(spark):
    rng = random.Random(17)
    benchmark = spark.createDataFrame([(0, ITEM), (1, FARM)], "item_id long, text string")
    renamed = FARM.replace("Tom", "Kim").replace("Anna", "Zoe").replace("14", "25")
    odd = FARM.replace("3 cows. Anna", "3 hens. Anna").replace("goats", "sheep")
    texts = {1: ITEM.lower(), 2: ITEM.upper(), 3: renamed, 4: FARM.lower(), 5: FARM.upper(), 6: odd,
             7: " ".join(FARM.split()[:14])}
    docs = [(i, f"{prose(rng, 50)}. {text} {prose(rng, 60)}") for i, text in texts.items()]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert set(got) == {(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)}
    assert got[3, 1].changed


def test_finds_items_without_plain_windows(spark):
    rng = random.Random(19)
    items = {0: "Compute 12 * 7 + 35 / 5 - 4 =", 1: "Anna Bell, Kim Lee 12 14 Zoe 3 Max 5", 2: "Define entropy", 3: "12 + 7 = ?",
             4: "Solve Kim", 5: "?!"}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = [(i, f"{prose(rng, 40)}. {text} {prose(rng, 40)}") for i, text in items.items()]
    docs += [(10, f"{prose(rng, 40)} {items[0].replace('12', '13').replace('35', '36')} x"), (11, prose(rng, 90) + " ? ?!")]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert set(got) == {(i, i) for i in range(5)}
    assert all(r.share == 1 and not r.changed for r in got.values())


def plain_templates(text):
    """Both readings of a text by a plain loop over its tokens: lists of (word or placeholder, value, first token)."""
    tokens, out = (text or "").split(), []
    for names in (True, False):
        found, ended, number_before = [], True, False
        for i, token in enumerate(tokens):
            word = token.strip(".,!?").lower()
            number, unit = word.isdigit(), word in ("kg", "km", "dollars") and number_before
            name = names and not number and not unit and (ended or word != token.strip(".,!?"))
            if number or unit:
                found.append(("<num>" if number else "<unit>", word, i))
            elif name and found and found[-1][0] == "<name>" and not ended and found[-1][3] == i - 1:
                found[-1] = ("<name>", f"{found[-1][1]} {word}", found[-1][2], i)
            else:
                found.append(("<name>", word, i, i) if name else (word, None, i))
            ended, number_before = token[-1] in ".!?", number
        out.append([f[:3] for f in found])
    return out


def brute(docs, items):
    """Every window of every item on every place of every document."""
    def windows_of(read):
        at = [read[i:i + 5] for i in range(len(read) - 4)]
        return [(i, tuple(w for w, _, _ in ws), tuple(v for _, v, _ in ws)) for i, ws in enumerate(at)
                if sum(v is None for _, v, _ in ws) >= 3]

    out = {}
    for d, text in docs:
        places = [windows_of(r) for r in plain_templates(text)]
        for i, item in items:
            reads = plain_templates(item)
            heads = [t for _, _, t in reads[0]]
            total = {heads[p] for p, _, _ in windows_of(reads[0])}
            laid = {}
            for read in reads:
                for p, words, values in windows_of(read):
                    head = max(h for h in heads if h <= read[p][2])
                    for own in places:
                        for q, there, filled in own:
                            if there == words and head in total:
                                pairs = [(x, y) for x, y in zip(values, filled) if x is not None]
                                laid.setdefault(q - p, []).append((head, pairs))
            found = set()
            for rows in laid.values():
                pairs = {p for _, ps in rows for p in ps}
                one = len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
                found |= {h for h, ps in rows if one or all(x == y for x, y in ps)}
            if total and len(found) >= 0.8 * len(total):
                out[d, i] = len(found)
    return out


def question(rng):
    names, units = ["Tom", "Anna", "Kim", "Zoe", "Max"], ["kg", "km", "dollars"]
    words = ["buys", "sells", "apples", "cows", "and", "how", "many", "gives", "to", "each", "box", "from", "then"]
    out = []
    for _ in range(rng.randint(2, 4)):
        n = rng.randint(5, 12)
        sentence = [rng.choice(words) if rng.random() < 0.75 else rng.choice([rng.choice(names), f"{rng.randint(2, 9)} {rng.choice(units)}"])
                    for _ in range(n)]
        sentence[0] = sentence[0] if rng.random() < 0.5 else rng.choice(names)
        out.append(" ".join(sentence)[:1].upper() + " ".join(sentence)[1:] + ".")
    return " ".join(out)


def test_equals_brute_force_with_names_numbers_and_units(spark):
    rng = random.Random(23)
    items = [(i, question(rng)) for i in range(12)]
    docs = []
    for i in range(90):
        text = rng.choice(items)[1]
        change = i % 6
        if change == 1:
            swap = dict(zip(["Tom", "Anna", "Kim", "Zoe", "Max"], ["Bo", "Cy", "Di", "Ed", "Flo"]))
            text = " ".join(swap.get(t.strip("."), t.strip(".")) + t[len(t.strip(".")):] for t in text.split())
        elif change == 2:
            text = text.replace("2", "33").replace("7", "2")
        elif change == 3:
            text = text.lower()
        elif change == 4:
            parts = text.split()
            parts[rng.randrange(len(parts))] = "other"
            text = " ".join(parts)
        elif change == 5:
            text = text.replace("Anna", "Tom").replace("3", "4")
        docs.append((i, f"{question(rng)} {text} {question(rng)}"))
    want = brute(docs, items)
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                spark.createDataFrame(items, "item_id long, text string"))
    assert {k: r.found for k, r in got.items()} == want and 50 < len(want) < 90


def test_values_map_one_to_one(spark):
    rng = random.Random(29)
    item = "Tom went with Anna to buy a box of apples. They paid 5 dollars, so Tom gave back 7 dollars to Anna from the money in the box."
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    texts = {1: item.replace("Tom", "Bill").replace("Anna", "Kim"), 2: item.replace("Tom", "Bill").replace("Anna", "Bill"),
             3: item.replace("so Tom", "so Max")}
    docs = [(i, f"{prose(rng, 30)}. {text} {prose(rng, 30)}") for i, text in texts.items()]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert (1, 0) in got and got[1, 0].changed and (2, 0) not in got
    # One changed value costs the windows that hold it: of a copy word for word the others are found.
    assert (3, 0) not in got or not got[3, 0].changed


def test_columns_with_clashing_names(spark, benchmark):
    table, other = benchmark
    names = ["id", "_id", "key", "held_id", "hash", "item_id", "share"]
    docs = spark.createDataFrame([(1, other, *names), (2, "another text", *names)], ["doc_id", "text", *names])
    left = clean(docs, table)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]
