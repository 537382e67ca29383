"""Spans, detection, replacement, scoring: invariants and cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from umbra.functions import patterns as P
from umbra.functions.scalars import endpoint, key, luhn, normal_text, slug, split_location
from umbra.functions.spans import find, resolve, splice
from umbra.operators import evaluate as E
from umbra.operators import replace as R
from umbra.operators.contextual import addresses, firm_name, organisations, person_name, persons
from umbra.operators.detect import detect, entities, with_context
from umbra.operators.propagate import Found, contains_value, missed, propagate, resolved
from umbra.plans import fixtures as X
from umbra.plans.forms import forms
from umbra.plans.queries import QUERIES
from umbra.plans.redaction import redact_units
from umbra.schema import PRIORITY, SPANS, TYPES, UNIT


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first().x


def unit_rows(spark, texts):
    return spark.createDataFrame([(1, "body", f"body:p{i:04d}", i, t) for i, t in enumerate(texts)], UNIT)


@pytest.mark.parametrize("java,python", [(P.EMAIL, P.EMAIL[4:]), (P.CARD, P.CARD[4:]), (P.PHONE, P.PHONE[4:]), (P.IPV4, P.IPV4[4:]), (P.SSN, P.SSN[4:])])
def test_spans_equal_finditer(spark, java, python):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123456789..--  ()+@ab_é😀\n") for _ in range(rng.randrange(60))) for _ in range(300)] + ["a@b.co", "éa@b.co", "😀 4111 1111 1111 1111"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", find(F.col("t"), java).alias("s"))
    for r in df.collect():
        assert [(s.start, s.end, s.value) for s in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(python, r.t)]


def random_spans(rng):
    out = []
    for _ in range(rng.randrange(9)):
        a = rng.randrange(30)
        z = a + rng.randrange(1, 12)
        out.append(Found(rng.choice(TYPES), a, z, "x" * (z - a), rng.choice([0.9, 0.95, 1.0]), "d", None))
    return out


def greedy(spans):
    """The rule as it is written: candidates one by one, against all that are kept."""
    kept = []
    for s in sorted(spans, key=lambda s: (s.start, s.start - s.end, -PRIORITY[s.type], -s.score)):
        rival = next((k for k in kept if k.meets(s.start, s.end)), None)
        if rival is None:
            kept.append(s)
        elif s.weight > rival.weight:
            kept.remove(rival)
            kept.append(s)
    return sorted((s.start, s.end, s.type, s.score) for s in kept)


def test_overlaps_resolve_alike(spark):
    rng = random.Random(2)
    sets = [random_spans(rng) for _ in range(200)]
    df = spark.createDataFrame([(i, [tuple(s) for s in x]) for i, x in enumerate(sets)], f"i int, s {SPANS}").withColumn("r", resolve(F.col("s")))
    for row in df.collect():
        got = sorted((s.start, s.end, s.type, s.score) for s in row.r)
        assert got == greedy(sets[row.i]) == sorted((s.start, s.end, s.type, s.score) for s in resolved(sets[row.i]))
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_splice(spark):
    parts = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(z).alias("end"), F.lit(t).alias("replacement")) for a, z, t in ((0, 2, "X"), (2, 3, ""), (5, 6, "long"))))
    assert one(spark, splice(F.col("t"), parts), t="abcdef😀h") == "Xdelong😀h"
    assert one(spark, splice(F.col("t"), F.slice(parts, 1, 0)), t="same") == "same"


def found(spark, text):
    return [(s.type, s.text) for s in detect(unit_rows(spark, [text])).first().spans]


def test_all_types_in_one_line(spark):
    line = "Name: Maya Verlin; maya@mailbox.example; +1-202-555-0147; Bramble Power Limited; Address: 12 Alder Road, Norvale 411038; SSN 219-09-9999; card 4111 1111 1111 1111; DOB 14/08/1998; 192.168.1.1"
    got = found(spark, line)
    assert {t for t, _ in got} == set(TYPES)
    assert ("ADDRESS", "12 Alder Road, Norvale 411038") in got and ("ORG", "Bramble Power Limited") in got


@pytest.mark.parametrize("text", ["Order 123456789; Invoice 1234567890123456; Revenue 2025; Page 123; Filing date: 12/01/2025", "Account No 4111111111111111", "recorded in 2023-2024", "999.1.1.1 and 01.2.3.4", "", "Order Number 9812345670"])
def test_nothing_found(spark, text):
    assert found(spark, text) == []


@pytest.mark.parametrize("text,value", [("Contact number 9812345670", "9812345670"), ("Phone: 9812345670", "9812345670"), ("09812345670", "09812345670"), ("+44 20 7946 0958", "+44 20 7946 0958")])
def test_phones(spark, text, value):
    assert found(spark, text) == [("PHONE", value)]


def test_entities_give_back_their_text(spark):
    texts = [t for group in (X.ADDRESSES, X.FIRMS, X.PERSONS, X.BIRTHS, X.SSN) for t in group] + ["", "é" * 30 + " a@b.co"]
    units = unit_rows(spark, texts)
    rows = entities(detect(with_context(units))).collect()
    assert rows and all(texts[r.seq][r.start : r.end] == r.text for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.seq, []).append((r.start, r.end))
    assert all(a[1] <= b[0] for spans in by.values() for a, b in zip(sorted(spans), sorted(spans)[1:]))


def test_partitions_do_not_matter(spark):
    units = X.documents(spark)
    a, b = (sorted(map(tuple, redact_units(units.repartition(n)).units.collect())) for n in (1, 7))
    assert a == b


def test_name_and_firm_rules():
    assert person_name("Mr Tarun N. Velmora Jr.") == "Tarun N. Velmora" and person_name("TARUN VELMORA") is None and person_name("Risk Factors") is None and person_name("Tarun") is None
    assert firm_name("our Company") is None and firm_name("The Larkspur Bank Limited") == "The Larkspur Bank Limited" and firm_name("Private Limited") is None
    assert [s.detector for s in organisations("Vendor: Tarn Works, later")] == ["organization-context"]
    assert [s.type for s in persons("Maya Verlin", "Name of the Director")] == ["PERSON"] * 2
    assert not list(addresses("road show presentation")) and not list(addresses("Form filed with registration number 5"))


def replaced(spark, kind, texts):
    rows = [(1, "u", i, kind, 0, len(t), t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, unit_id string, seq int, type string, start int, end int, text string, identity string")
    return [r.replacement for r in R.replacements(df).orderBy("seq").collect()]


def digits(text):
    return re.sub(r"\D", "", text)


def valid(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_replacements(spark):
    a, b, c = replaced(spark, "PHONE", ["+91 98123 45670", "+91-98123-45670", "+91 98123 45671"])
    assert digits(a) == digits(b) != "919812345670" and a[:3] == "+91" and digits(c) != digits(a)
    people = replaced(spark, "PERSON", ["Maya Verlin", "maya  VERLIN", "Aarav Mehta"])
    assert people[0] == people[1] != people[2] and "Aarav Mehta" not in people
    assert replaced(spark, "EMAIL", ["a@b.co"]) == ["aarav.mehta@example.com"] and replaced(spark, "IP", ["1.11.1.1", "11.1.1.1"]) == ["203.0.113.10", "203.0.113.11"]
    assert replaced(spark, "CREDIT_CARD", ["4111 1111 1111 1111"]) == ["4242 4242 4242 4242"]
    cards = ["4" * n for n in range(13, 20)]
    assert all(len(x) == len(y) and valid(x) for x, y in zip(replaced(spark, "CREDIT_CARD", cards), cards))
    assert replaced(spark, "SSN", ["219-09-9999"]) == ["900-00-1234"]
    dates = ["14/08/1998", "14-08-1998", "1998-08-14", "August 14, 1998", "Aug 14 1998", "14th August 1998", "14/8/1998"]
    assert replaced(spark, "DOB", dates) == ["23/05/1997", "23-05-1997", "1997-05-23", "May 23, 1997", "May 23 1997", "23rd May 1997", "23/5/1997"]
    assert replaced(spark, "ORG", list(P.ORG_POOL)) == [f"Example Synthetic Holdings {i} Limited" for i in range(1, 7)]
    homes = replaced(spark, "ADDRESS", [f"{i} Alder Road" for i in range(6)] + ["5 Elm Street, TX"])
    assert len(set(homes)) == 7 and homes[0] == P.INDIA_POOL[0]


def test_serials_do_not_run_out(spark):
    people = replaced(spark, "PERSON", [f"Person Number{i}" for i in range(300)])
    assert len(set(people)) == 300 and people[299] == "Example Person 300"


@pytest.mark.parametrize("text,value,there", [("standards abroad", "Broad", False), ("and Broad Fir Trust,", "broad", True), ("KVL\nMarlin\nPrivate Limited", "KVL Marlin Private Limited", True), ("KVL Marlin Private", "KVL Marlin Private Limited", False), ("Telephone: +91 9812345670.", "+91 9812345670", True), ("x", " ", False), ("a.b", "a+b", False)])
def test_whole_values(spark, text, value, there):
    assert one(spark, contains_value(F.col("t"), F.col("v")), t=text, v=value) is there


def test_scalars(spark):
    assert one(spark, key(F.col("t")), t="  Straße \n X ") == "strasse x" and one(spark, normal_text("t"), t="ＡＢ  ß") == "ab ss"
    assert one(spark, slug(F.col("t")), t="--Maya  Verlin.") == "maya.verlin" and one(spark, slug(F.col("t")), t="--") == "user"
    assert one(spark, luhn(F.col("t")), t="0") is False and one(spark, luhn(F.col("t")), t="4111111111111111") is True
    assert one(spark, endpoint(F.col("t")), t="HTTPS://u@Host.org/p?q") == "https://Host.org" and one(spark, endpoint(F.col("t")), t="nothing") == "(unparseable)"
    part, unit = split_location(F.col("t"))
    assert one(spark, F.concat_ws("|", part, unit), t="/word/header1.xml:p0001:x") == "header1.xml|p0001:x"


def test_scores_without_items(spark):
    none = X.truth(spark).limit(0)
    rows = E.by_type(none, none).collect()
    assert [r.precision for r in rows] == [None] * 9 and {r.type for r in rows} == set(TYPES)
    with pytest.raises(Exception, match="unknown type"):
        E.by_type(spark.createDataFrame([(0, "NOPE", "x", "u", None)], X.ITEM), none).collect()


def test_repeated_values_match_by_unit(spark):
    item = lambda i, u: (i, "PERSON", "Maya Verlin", u, None)
    truth = spark.createDataFrame([item(0, "b:p1"), item(1, "b:p2")], X.ITEM)
    guess = spark.createDataFrame([item(0, "b:p1"), item(1, "b:p3")], X.ITEM)
    row = E.by_type(truth, guess).where("type = 'PERSON'").first()
    assert (row.TP, row.FP, row.FN) == (1, 1, 1)


def test_chunks_close_at_the_limit(spark):
    chunks = E.chunk_manifest(E.chunked(unit_rows(spark, ["x" * 60] * 5 + [" "]), most=200)).orderBy("chunk").collect()
    assert [(c.units, c.first_id) for c in chunks] == [(2, "body:p0000"), (2, "body:p0002"), (1, "body:p0004")]


def test_documents_do_not_match_each_other(spark):
    item = lambda i, d, u="b:p1", t="PERSON": (i, d, t, "Maya Verlin", u, None)
    schema = X.ITEM.replace("id long,", "id long, doc_id long,")
    truth = spark.createDataFrame([item(0, 1), item(1, 1), item(0, 2), item(5, 0), item(7, None)], schema)
    guess = spark.createDataFrame([item(0, 2), item(1, 2), item(0, 1), item(9, 3), item(4, None)], schema)
    row = E.by_type(truth, guess).where("type = 'PERSON'").first()
    assert (row.TP, row.FP, row.FN) == (3, 2, 2)
    missed, wrong = E.unmatched(truth, guess)
    assert sorted((r.doc_id, r.id) for r in missed.collect()) == [(0, 5), (1, 1)] and sorted((r.doc_id, r.id) for r in wrong.collect()) == [(2, 1), (3, 9)]
    # without documents on one side all items are of one
    assert E.by_type(truth.drop("doc_id").withColumn("id", F.monotonically_increasing_id()), guess).where("type = 'PERSON'").first().TP == 5


def test_matches_against_the_rule_read_one_by_one(spark):
    rng = random.Random(7)
    pick = lambda i: (i, rng.choice([1, 1, 2]), rng.choice(["ORG", "IP"]), rng.choice(["A b", "a  B", "c"]), rng.choice(["b:p1", "b:p2", "/b:p1", "b", "h:p1", "", None]), rng.choice([None, None, None, "x", "x y", "z"]))
    schema = X.ITEM.replace("id long,", "id long, doc_id long,")
    for plain in (False, True):
        sides = [[pick(i) for i in range(70)] for _ in range(2)]
        if plain:
            sides = [[(*x[:4], x[4] if x[4] and ":" in x[4] else "b:p3", None) for x in side] for side in sides]

        def parts(x):
            place = (x[4] or "").lstrip("/")
            return place, place.split(":")[0], place.split(":")[1] if ":" in place else "", " ".join((x[5] or "").split()).casefold()

        want, free = set(), list(sides[1])
        for a in sorted(sides[0], key=lambda a: (-(10 * bool(parts(a)[0]) + 5 * bool(parts(a)[3])), a[0])):
            for b in free:
                (p, part, unit, near), (q, part_b, unit_b, near_b) = parts(a), parts(b)
                same = a[1:3] == b[1:3] and " ".join(a[3].split()).casefold() == " ".join(b[3].split()).casefold() and part == part_b and bool(p) == bool(q)
                if same and (not unit or not unit_b or unit == unit_b) and (not near or not near_b or near in near_b or near_b in near):
                    want.add((a[1], a[0], b[0]))
                    free.remove(b)
                    break
        got = {tuple(r) for r in E.matches(*(spark.createDataFrame(x, schema) for x in sides)).collect()}
        assert got == want


def test_texts_that_hold_a_contextual_value_go_to_python(spark):
    """The words checked in the JVM never keep a text from the rules that would hit."""
    from umbra.operators.contextual import worth

    rng = random.Random(3)
    pieces = [w for group in (X.ADDRESSES, X.FIRMS, X.PERSONS, X.BIRTHS) for t in group for w in (t, *t.split())] + ["Registered\u00a0office:", "LIMITED", "Ab", "AB", "namely", "being", "expert", "from", "consent", "12", "é", "_", "411\x1c038", "\n", ";", "Ltd.", "MAYA", "Maya", "Olga"]
    contexts = ["", "Contact person", "Address", "Name of the Director", "x"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))) if i % 3 else " ".join(rng.choice(pieces) for _ in range(5)), rng.choice(contexts)) for i in range(1500)]
    bits = {r.i: r.b for r in spark.createDataFrame(rows, "i int, t string, c string").select("i", worth(F.col("t"), F.col("c")).alias("b")).collect()}
    hit = [0, 0, 0]
    for i, t, c in rows:
        for k, found in enumerate((addresses(t, c), organisations(t), persons(t, c))):
            if list(found):
                hit[k] += 1
                assert bits[i] >> k & 1, (k, t, c)
    assert min(hit) > 20 and sum(b == 0 for b in bits.values()) > 20


def test_values_over_edges_against_windows():
    """Atoms of one stream against patterns over all windows of units."""
    from umbra.operators.propagate import WIDEST, Seed, over_many

    rng = random.Random(5)
    seeds = [Seed("PERSON", v) for v in ("Maya Verlin", "Maya B. Oslin", "A & B Ltd.", "B C", "Maya (M) Oslin")]
    words = ["Maya", "VERLIN", "Verlin,", "B.", "Oslin", "B", "C", "A", "&", "Ltd.", "(M)", "xMaya", "é", "C_", ""]
    for _ in range(400):
        texts = [rng.choice(["", " "]) + " ".join(rng.choice(words) for _ in range(rng.randrange(3))) for _ in range(rng.randrange(1, 9))]
        want = set()
        for s in seeds:
            pattern = r"(?<![A-Za-z0-9_])" + r"\s+".join(map(re.escape, s.value.split())) + r"(?![A-Za-z0-9_])"
            for at in range(len(texts)):
                for width in range(2, min(WIDEST, len(texts) - at) + 1):
                    joined, starts = "", []
                    for t in texts[at : at + width]:
                        starts.append(len(joined))
                        joined += t + " "
                    for m in re.finditer(f"(?=({pattern}))", joined, re.IGNORECASE):
                        a, z = m.span(1)
                        held = [(at + k, max(a, b) - b, min(z, b + len(t)) - b) for k, (b, t) in enumerate(zip(starts, texts[at : at + width])) if a < b + len(t) and b < z]
                        first, last = max(k for k, b in enumerate(starts) if b <= a), max(k for k, b in enumerate(starts) if b < z)
                        if last > first and len(held) == last - first + 1 and all(texts[k][x:y].strip() for k, x, y in held):
                            want.add((s.value, tuple(held)))
        assert {(s.value, tuple(where)) for s, where in over_many(texts, seeds)} == want


def test_halves_of_values():
    from umbra.operators.propagate import Seed, over_two

    def pieces(texts, value):
        return [[(u, texts[u][a:z]) for u, a, z in where] for _, where in over_two(texts, [Seed("PERSON", value)])]

    assert pieces(["signed by Tarun", "Velmora for all"], "Tarun Velmora") == [[(0, "Tarun"), (1, "Velmora")]]
    assert pieces(["by TARUN, ", " velmora Oslin."], "Tarun Velmora Oslin") == [[(0, "TARUN, "), (1, " velmora Oslin")]]
    for texts, value in ((["by tarun", "Velmora"], "Tarun Velmora"), (["the Bank", "Limited now"], "Bank Limited"), (["by Tarun", "", "Velmora"], "Tarun Velmora"), (["x@Tarun", "Velmora"], "Tarun Velmora"), (["Tarun", "Velmoras"], "Tarun Velmora"), (["A Tarun &", "Velmora"], "Tarun & Velmora"), (["Tarun Velmora"], "Tarun Velmora")):
        assert pieces(texts, value) == []


def test_merge_within_documents(spark):
    units = spark.createDataFrame([(1, "u", "Maya Verlin Oslin"), (2, "u", "by Maya Verlin")], "doc_id long, unit_id string, text string")
    records = spark.createDataFrame([(0, 1, "u", "PERSON", "Maya Verlin"), (1, 1, "u", "PERSON", "Maya Verlin Oslin"), (2, 2, "u", "PERSON", "Maya Verlin"), (3, 2, "u", "PERSON", "Oslin")], "id long, doc_id long, unit_id string, type string, text string")
    kept, rejected, dropped = E.merge(records, units)
    assert [(r.doc_id, r.start, r.end) for r in E.in_order(kept).collect()] == [(1, 0, 17), (2, 3, 14)]
    assert [(r.id, r.reason) for r in rejected.collect()] == [(3, "not found")] and [(r.doc_id, r.text) for r in E.dropped_examples(dropped).collect()] == [(1, "Maya Verlin")]
    assert [r.problem for r in E.validate(kept, units).collect()] == [None, None]


def test_seeds_turn_the_pools(spark):
    rows = [(1, "u", i, "PERSON", 0, 1, t, None) for i, t in enumerate(("A B", "C D"))]
    df = spark.createDataFrame(rows, "doc_id long, unit_id string, seq int, type string, start int, end int, text string, identity string")
    by = {seed: [r.replacement for r in R.replacements(df, seed=seed).orderBy("seq").collect()] for seed in (1337, 1338, 1353)}
    assert by[1337] == by[1353] == ["Aarav Mehta", "Maya Carter"] and by[1338] == ["Maya Carter", "Rohan Shah"]


def test_serials_of_a_whole_corpus(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), "u", rng.randrange(9), kind, 0, 3, f"Value {rng.randrange(150)}", None) for kind in ("ORG", "PERSON") for _ in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, unit_id string, seq int, type string, start int, end int, text string, identity string").repartition(5)
    got = {(r.type, r.key): r.serial for r in R.serials(df, []).collect()}
    for kind in ("ORG", "PERSON"):
        first = {}
        for d, _, seq, k, *_, text, _ in rows:
            if k == kind:
                first[text.lower()] = min(first.get(text.lower(), (99, 99)), (d, seq))
        want = sorted(first, key=lambda v: (first[v], v))
        assert [got[kind, v] for v in want] == list(range(len(want)))


def test_values_that_stand_again_where_no_detector_takes_them(spark):
    """Before a full stop, next to other digits, after a word that speaks against the kind; not in another document."""
    from umbra.operators.propagate import residuals
    from umbra.operators.verify import values
    from umbra.sources.tables import lines

    texts = ["mail 25.36.57.9 up\nsee 25.36.57.9.", "ab.1@mail1.example.com here\nask AB.1@mail1.example.com.", "+1 (836) 555-9331 is\nthe +1 (836) 555-9331 29.217.118.233 end", "pay 4111111111111111 now\norder no 4111111111111111", "see 25.36.57.9."]
    units = lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", F.col("text"), "body")
    done = redact_units(units, contextual=False, context=False)
    assert residuals(values(done.entities), done.units).count() == 0
    found = {(r.doc_id, r.seq, r.text) for r in done.entities.where("detector = 'document-repeat'").collect()}
    assert found == {(0, 1, "25.36.57.9"), (1, 1, "AB.1@mail1.example.com"), (2, 1, "+1 (836) 555-9331"), (3, 1, "4111111111111111")}
    out = {(r.doc_id, r.seq): r.text for r in done.units.collect()}
    assert out[0, 0].split()[1] + "." == out[0, 1].split()[1] and out[4, 0] == "see 25.36.57.9."


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_units_do_not_pass_through_the_driver(spark):
    """A form is sixteen units and planned as one row of a few bytes, so each join would send all of them."""
    units = forms(spark, "/root/testdata/sf0.001")
    found = entities(propagate(detect(with_context(units))))
    for plan in (planned(found), planned(missed(found, units)), planned(R.redact(units, R.replacements(found)))):
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["form_redacted", "form_summary", "form_scores"])
def test_plans_hold_no_copies_of_the_detection(spark, name):
    """They were of 60 to 200 copies of it, kept by the driver with each stage that ends."""
    plan = planned(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in plan and len(plan) < 200_000
    assert all("[type#" in x for x in plan.splitlines() if "BroadcastHashJoin" in x)  # a row for each type at most


def test_words_are_those_of_the_described_tool(spark):
    """Marks and joiners are no part of a word, numbers like ² are: in the sweep and in the detectors of structured values."""
    values = ("+1 (242) 555-3475", "5551234567", "81.117.17.241", "ab.12@mail1.example.com")
    texts = [t for c in "²½Ⅷ́ः‿‍_é." for v in values for t in (f"a {c}{v} b", f"a {v}{c} b", f"Contact{c} {v}")]
    units = unit_rows(spark, texts)
    shaped = {(r.unit_id, r.type, r.start, r.end) for r in E.sweep(units).collect()}
    assert shaped == {(f"body:p{i:04d}", k, m.start(), m.end()) for i, t in enumerate(texts) for k, p in (("EMAIL", P.SWEEP_EMAIL), ("PHONE", P.SWEEP_PHONE)) for m in re.finditer(p[4:], t)}
    found = {(r.seq, r.type, r.start, r.end) for r in entities(detect(units, contextual=False)).collect()}
    told = lambda t: re.search(P.PHONE_WORDS.replace("(?iU)", "(?i)"), t)
    for kind, pattern in (("EMAIL", P.EMAIL), ("IP", P.IPV4), ("PHONE", P.PHONE)):
        hits = {(i, kind, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer(pattern[4:], t) if kind != "PHONE" or (values[2] not in t and ("+" in m[0] or told(t[: m.start()])))}
        assert {f for f in found if f[1] == kind and (kind != "PHONE" or values[2] not in texts[f[0]])} == hits, kind
