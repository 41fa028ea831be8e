import random
import re

import pytest

from gleaner.llm import decontaminate as D

ITEM = "Anna paid 40 dollars for 3 kg of green apples while her neighbour Boris bought 3 kg of sour plums for 55 dollars"
SWAPPED = "Clara paid 75 dollars for 8 kg of green apples while her neighbour Denis bought 8 kg of sour plums for 99 dollars"
MIXED = "Clara paid 75 dollars for 8 kg of green apples while her neighbour Denis bought 9 kg of sour plums for 99 dollars"
FILL = "some other words that stand before and after it in every text of the set "


def brute(docs, items):
    """Plain canonical words, all pairs of windows."""

    def canonical(words):
        out = []
        for k, w in enumerate(words):
            core = w.strip(D.OUTER) or w
            opens = k == 0 or words[k - 1].endswith(D.STOP)
            before = k and (D.NUMBER.fullmatch(words[k - 1].strip(D.OUTER) or words[k - 1]))
            kind = "<num>" if D.NUMBER.fullmatch(core) else "<unit>" if core.lower() in D.UNITS and before else "<name>" if core.lower() not in D.UNITS and core[0].isupper() and not opens else None
            out.append((kind or core.lower(), core, kind))
        return out

    def windows(text):
        c = canonical((text or "").split())
        span = min(D.SPAN, len(c))
        for k in range(len(c) - span + 1 if c else 0):
            part = c[k : k + span]
            if sum(x[2] is None for x in part) >= min(D.LITERAL, span):
                yield k, tuple(x[0] for x in part), part, len(c)

    index = {}
    for n, (item, text) in enumerate(items):
        for p, key, part, size in windows(text):
            index.setdefault(key, []).append((n, item, p, part, size))
    out = []
    for i, text in docs:
        lines = {}
        for p, key, part, _ in windows(text):
            for n, item, q, other, size in index.get(key, ()):
                at, pairs = lines.setdefault((n, item, size), {}).setdefault(p - q, (set(), set()))
                at |= set(range(q, q + len(part)))
                pairs |= {(y[1], x[1]) for x, y in zip(part, other, strict=True) if y[2]}
        hit, most = [], 0
        for (n, item, size), diagonals in lines.items():
            groups, last = [], None
            for d in sorted(diagonals):
                if last is None or d - last > D.NEAR:
                    groups.append((set(), set()))
                groups[-1][0].update(diagonals[d][0])
                groups[-1][1].update(diagonals[d][1])
                last = d
            best = max((len(at) for at, pairs in groups if len(at) >= min(size, D.LEAST) and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})), default=0)
            if best:
                hit.append(item)
                most = max(most, best)
        out.append((i, bool(hit), sorted(hit), most))
    return out


@pytest.fixture(scope="module")
def given(spark, rows):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, ITEM), (901, None), (902, ""), (903, "tiny item here"), (904, ITEM)]
    rng, own = random.Random(4), []
    for k, text in enumerate([ITEM, SWAPPED, MIXED, "tiny item here", *[t for _, t in items[:20]]]):
        words = text.split()
        own.append((500_000 + 10 * k, FILL + text + " " + FILL))
        own.append((500_001 + 10 * k, FILL + " ".join(words[: len(words) // 2])))
        words.insert(rng.randrange(len(words)), "inserted")
        own.append((500_002 + 10 * k, " ".join(words) + "\n" + FILL))
    return rows + own, items


def test_against_brute_force(spark, given, same):
    docs, items = given
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "contaminated", "item_ids", "covered")
    want = brute(docs, items)
    same(D.digests(df, bench), columns, want)
    same(D.digests(df.selectExpr("*", "1 as owner", "2 as side", "'x' as canon"), bench.selectExpr("*", "1 as h", "3 as pos")), columns, want)


def test_templates(given):
    found = {i: (hit, items) for i, hit, items, _ in brute(*given)}
    assert found[500_000] == (True, [900, 904])  # verbatim
    assert found[500_010] == (True, [900, 904])  # other numbers and names
    assert found[500_020] == (False, [])  # one number is inconsistent
    assert found[500_030] == (False, [])  # an item shorter than a window
    assert all(found[500_000 + 10 * k][0] for k in range(4, 24))


def test_empty_tables(spark, given, empty):
    docs, items = given
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.digests(empty, bench).count() == 0
    few = spark.createDataFrame(docs[:5], "doc_id long, text string")
    assert {r.contaminated for r in D.digests(few, bench.limit(0)).collect()} == {False}


def test_regex_of_numbers():
    assert all(D.NUMBER.fullmatch(x) for x in ("4", "-4.5", "1,000", "50%", "$3", "2nd", "1/2")) and not re.fullmatch(D.NUMBER, "a4")


def found_in(spark, text, item):
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    return D.digests(docs, bench).first().item_ids == [7]


def test_one_slot_does_not_veto_what_agrees(spark):
    rest = "walked to the old market near the river and came home with bread and cheese before it got dark outside"
    assert found_in(spark, f"{FILL} {rest} and later Anna met Clara", f"so {rest} and later Anna met Anna")  # one name edited
    item = "the box has 3 red balls and 5 blue balls so how many of all the balls are in it"
    assert found_in(spark, FILL + item.replace("3", "4").replace("5", "4"), item)  # two numbers become the same
    assert not found_in(spark, FILL + item.replace("3", "4").replace("5", "7").replace("all the", "3 the"), item.replace("5", "3").replace("all the", "3 the"))


@pytest.mark.parametrize(
    "item",
    [
        "purple otters juggle warm lanterns",  # shorter than a window
        "3 7 12 19 28 39 52 67 84 103 124 147 172 199",  # numbers alone
        "King Lear Asks His Three Daughters How Much They Love Him Before All His Court",  # title case
        "WHICH OF THE FOLLOWING PLANETS IS THE LARGEST ONE OF ALL THE KNOWN ONES",
        "after a few words that come first " + " ".join(str(k * k) for k in range(20)),  # a long run without literals
        "Which river of the country flows through most of its towns",  # its first word stands inside a sentence
    ],
)
def test_verbatim_copies_of_all_kinds_of_items(spark, item):
    assert found_in(spark, f"{FILL}\n{item} {FILL}", item) and found_in(spark, f"{FILL} {item.lower()}. {FILL}", item)
    assert not found_in(spark, f"{FILL} {' '.join(item.split()[:-1])} {FILL}" if len(item.split()) <= D.LEAST else FILL, item)


def test_short_item_with_other_numbers_inside_a_sentence(spark):
    item = "Take 3 apples from the large bowl and eat 2"
    assert found_in(spark, FILL + item.replace("3", "8").replace("2", "5") + " " + FILL, item)


@pytest.mark.parametrize("salted", [False, True])
def test_shared_phrases_count_for_every_item(spark, monkeypatch, same, salted):
    """Sixty items open with the same phrase of twenty words: a text with the phrase covers enough of each."""
    if salted:
        monkeypatch.setattr(D, "RUNS", -1)
    phrase = " ".join(f"choose{k}" for k in range(20))
    items = [(k, f"{phrase} " + " ".join(f"w{k}x{j}y" for j in range(20))) for k in range(60)] + [(100 + k, phrase) for k in range(3)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"before it {phrase} behind it"), (2, f"so: {items[7][1]} then"), (3, "nothing of this"), (4, " ".join(items[9][1].split()[20:34])), (5, " ".join(phrase.split()[3:15]) + " and no more"), (6, " ".join(items[5][1].split()[9:30]))]
    want = brute(rows, items)
    assert want[0][2] == [*range(60), 100, 101, 102] and want[4][1] is False and want[5][2] == [5]
    same(D.digests(spark.createDataFrame(rows, "doc_id long, text string"), benchmark), ("doc_id", "contaminated", "item_ids", "covered"), want)


@pytest.mark.parametrize("n", [32, 33])
def test_a_phrase_of_many_items(spark, n):
    phrase = " ".join(f"stock{k}" for k in range(18))
    benchmark = spark.createDataFrame([(k, f"{phrase} " + " ".join(f"own{k}x{j}" for j in range(9))) for k in range(n)], "item_id long, text string")
    r = D.digests(spark.createDataFrame([(1, f"some {phrase} rest")], "doc_id long, text string"), benchmark).first()
    assert r.item_ids == list(range(n)) and r.covered == 18


def test_items_of_stock_phrases_alone(spark, monkeypatch):
    """Items put together from few phrases, each shorter than what counts, shared by many items and repeated inside some."""
    rng = random.Random(8)
    phrases = [" ".join(f"{a}{k}" for k in range(n)) for a, n in zip("abcdef", (8, 9, 10, 11, 12, 8), strict=True)]
    items = [(k, " ".join(rng.choice(phrases) for _ in range(rng.randint(1, 4)))) for k in range(80)]
    items += [(200 + k, f"{rng.choice(phrases)} {k} {k + rng.randint(0, 2)} kg {rng.choice(phrases)}") for k in range(20)]
    rows = [(k, " ".join([FILL, *(rng.choice([*phrases, "x y z", "7", "Then Anna"]) for _ in range(rng.randint(1, 5)))])) for k in range(60)] + [(100 + i, f"{FILL} {t}") for i, t in items[:15]]
    want = brute(rows, items)
    tables = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in D.digests(*tables).collect())
    assert sum(r[1] for r in want) > 20 and not all(r[1] for r in want)
    assert all(set(ids) <= set(r[2]) for (_, _, ids, _), r in zip(sorted(want), got, strict=True))  # the library also takes what agrees where a value does not
    monkeypatch.setattr(D, "handed_on", lambda lines, members: lines.join(members, "run"))  # every pair opened
    assert sorted(tuple(r) for r in D.digests(*tables).collect()) == got


def test_extra_columns_and_empty_tables(spark, docs, clashing, empty):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    a, b = (sorted((r.doc_id or -1, r.contaminated, r.item_ids, r.covered) for r in D.digests(x, benchmark).collect()) for x in (docs, clashing))
    assert a == b and any(r[1] for r in a)
    assert D.digests(empty, benchmark).count() == 0
    assert {r.contaminated for r in D.digests(docs, benchmark.limit(0)).collect()} == {False}
