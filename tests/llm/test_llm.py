"""Small and edge inputs of the training-data operators, each against brute force or a public library."""

import base64
import random
from collections import Counter

import numpy as np
import pytest

from vitaeflow.llm import byte_bpe, canonical, consensus, leakage, near_duplicates, personal_data, spam_pages

VOCABULARY = byte_bpe.public_vocabulary()
TEXTS = ["Hello world, it's 2024!", "", None, "  \n\t x", "naïve café 東京 😀", "a" * 3000, "=-" * 1500, "<|endoftext|>", "x\u0085y\u001c z"]


# -- tokenizer -------------------------------------------------------------------------------------------------


def test_ids_equal_a_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again")], "k long, t string, ids string")
    out = {r["k"]: list(r["ids"]) for r in byte_bpe.encode_texts(df, "k", "t", VOCABULARY).collect()}
    assert out == {i: own.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


def test_ids_of_an_empty_table_and_null_key(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a")], "k long, t string")
    assert byte_bpe.encode_texts(df.limit(0), "k", "t", VOCABULARY).count() == 0
    assert byte_bpe.encode_texts(df, "k", "t", VOCABULARY).count() == 1


# -- leakage ---------------------------------------------------------------------------------------------------

RNG = random.Random(5)
WORDS = [f"{a}{b}" for a in "alder birch cedar delta ember fjord gleam".split() for b in "on ix ar um et".split()]
ITEMS = [(i, " ".join(RNG.choice(WORDS) for _ in range(40))) for i in range(6)]


def changed(words, edits):
    words = list(words)
    for at in RNG.sample(range(len(words)), edits):
        words[at] = RNG.choice([RNG.choice(WORDS), "zzz", ""])
    return " ".join(w for w in words if w)


@pytest.mark.parametrize("most", [leakage.INDEX_WORDS, 0])  # by an index in the tasks, and by a join of windows
def test_leaks(spark, monkeypatch, most):
    monkeypatch.setattr(leakage, "INDEX_WORDS", most)
    docs, want = [], set()
    for d in range(120):
        item = RNG.randrange(6)
        n, edits = RNG.choice([(15, 0), (16, 1), (24, 2), (32, 3)])
        start = RNG.randrange(0, 40 - n)
        inner = changed(ITEMS[item][1].split()[start : start + n], edits)
        lead = " ".join(f"word{RNG.randrange(999)}" for _ in range(30))
        docs.append((d, f"{lead}\n<b>{inner.upper()}</b>, \"{lead}\"", "x"))
    for d, t, _ in docs:
        words = leakage.words_of(t)
        index = leakage.build_index(ITEMS)
        ids = np.array([index.vocabulary.get(w, 0) for w in words])
        for i, item in ITEMS:
            if leakage.follows(ids, np.arange(len(ids)), np.array([index.vocabulary[w] for w in item.split()])):
                want.add((d, i))
    docs += [(900, None, "x"), (901, "", "x"), (902, ITEMS[0][1].replace(" ", "\n"), "x"), (902, ITEMS[0][1].replace(" ", "\n"), "y"), (903, " ".join(ITEMS[1][1].split()[:14]), "x")]
    want.add((902, 0))
    df = spark.createDataFrame(docs, "doc long, body string, i string")
    items = spark.createDataFrame([*ITEMS, (7, None), (8, "too short")], "i int, t string")
    got = [(r["doc"], r["i"]) for r in leakage.find_leaks(df, "doc", "body", items, "i", "t").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.02 * len(want)
    assert leakage.find_leaks(df.limit(0), "doc", "body", items, "i", "t").count() == 0
    assert leakage.find_leaks(df, "doc", "body", items.limit(0), "i", "t").count() == 0


# -- near duplicates -------------------------------------------------------------------------------------------


def similarity(a, b):
    x, y = Counter(near_duplicates._WORD.findall(a.lower())), Counter(near_duplicates._WORD.findall(b.lower()))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(80)]
        for _ in range(rng.choice([1, 2, 4])):
            t = list(base)
            for at in rng.sample(range(80), rng.choice([0, 2, 5])):
                t[at] = rng.choice(vocabulary)
            rng.shuffle(t)
            rows.append(" ".join(t))
    rows += [rows[0].upper(), rows[0], "a b c", "", None, "w " * 30, "w " * 30]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)] + [(0, rows[0], 2), (None, rows[1], 3)], "class long, t string, rep int")
    members, links = near_duplicates.near_duplicates(df, "class", "t")
    got = {(r["a"], r["b"]) for r in near_duplicates.duplicate_pairs(members, links).collect()}
    long = [(i, t) for i, t in enumerate(rows) if t and len(near_duplicates._WORD.findall(t)) >= 20]
    want = {(i, j) for i, a in long for j, b in long if i < j and similarity(a, b) >= 0.75}
    assert got == want and members.select("id").distinct().count() == members.count()


def test_near_duplicates_of_nothing(spark):
    members, links = near_duplicates.near_duplicates(spark.createDataFrame([], "k long, t string"), "k", "t")
    assert members.count() == 0 and links.count() == 0


# -- canonical values ------------------------------------------------------------------------------------------

REFS = [(1, "skill", "unit testing"), (2, "skill", "backup and restore"), (3, "title", "backend developer"), (4, "title", "regional sales manager"), (5, "skill", "tandem basic"), (6, "skill", "ostradb"), (7, "title", "human resources advisor")]


@pytest.fixture(scope="module")
def mapped(spark):
    typed = {
        ("skill", "Unit Testing"): 1, ("skill", "unit testnig (advanced)"): 1, ("skill", "testing unit"): 1, ("skill", "únit_tеsting"): 1, ("skill", "unittesting"): 1, ("skill", "unit test."): 1, ("skill", "and restore backup"): 2, ("skill", "basic tandem basic"): 5, ("skill", "tandem-basic"): 5, ("skill", "Otsradb v2"): 6,
        ("title", "Senior BackendDeveloper"): 3, ("title", "developer (backend)"): 3, ("title", "manager, regional sales"): 4, ("title", "HR advisor"): 7, ("title", "human resouces advisor @ night shift"): 7, ("skill", "backend developer"): 0, ("skill", "glass blowing"): 0, ("title", "N/A"): 0, ("title", "?"): 0, ("skill", "x" * 50_000): 0,
    }
    values = spark.createDataFrame([(*k, "c") for k in typed] * 2 + [("skill", None, "c"), ("skill", "   ", "c"), (None, "unit testing", "c")], "kind string, raw string, words string")
    refs = spark.createDataFrame([(*r, "q") for r in REFS] + [(9, "skill", None, "q")], "ref_id int, kind string, canonical string, s string")
    return typed, canonical.map_to_canonical(values, refs).collect(), values, refs


def test_values_and_their_entries(mapped):
    typed, rows, _, _ = mapped
    got = {(r["kind"], r["raw"]): r["ref_id"] for r in rows if r["kind"]}
    assert len(rows) == len(typed) + 1 and got == typed


def test_no_entries_and_no_values(mapped):
    _, _, values, refs = mapped
    assert {r["ref_id"] for r in canonical.map_to_canonical(values, refs.limit(0)).collect()} == {0}
    assert canonical.map_to_canonical(values.limit(0), refs).count() == 0


def test_unrelated_names_hardly_meet(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("aabcdeeefghiijklmnooprsttuvwyz") for _ in range(rng.randrange(6, 15)))
    refs = spark.createDataFrame([(i, "t", name()) for i in range(1000)], "ref_id int, kind string, canonical string")
    typed = spark.createDataFrame([("t", name()) for _ in range(2000)], "kind string, s string").distinct()
    forms = canonical.reference_forms(refs, "kind", "ref_id", "canonical")
    assert canonical.edit_candidates(typed, forms, lambda d: d).count() < 20_000
    assert canonical.word_candidates(typed.select(typed.s.alias("w")), forms.select(forms.s.alias("r")).distinct(), lambda d: d).count() < 20_000


def test_many_shortened_words(spark):
    refs = spark.createDataFrame([(1, "t", "head of regional sales planning and market research operations"), (2, "t", "assistant"), (3, "t", "regional sales manager")], "ref_id int, kind string, canonical string")
    typed = {"head of reg. sls planning and mkt research operations": 1, "assist": 2, "rgnl sls mgr": 3, "sls mgr regional": 3, "ast": 0, "xx yy zz": 0}
    values = spark.createDataFrame([("t", v) for v in typed], "kind string, raw string")
    assert {r["raw"]: r["ref_id"] for r in canonical.map_to_canonical(values, refs).collect()} == typed


# -- personal data ---------------------------------------------------------------------------------------------

GIVEN = frozenset({"zoë", "haruto", "lubna"})
KEY = "a key of this test"


def lexicon(spark):
    return spark.createDataFrame([(g,) for g in sorted(GIVEN)], "given string")


CV = "Name: Zoë van der Luskazar\nZOE_L+JOBS@MAILBOX.EXAMPLE | ☎ +44 7700 900123 ext. 12\nHome: Flat 6A, 75 Rookery Street, Corvale XV29 3AQ\nSSN: 00967-2385054-4, ticket INC-6699-6366346, part number 555-9564-B\nReported to Lubna Savquist at Harlan Vance GmbH. Haruto Vance Ltd, build 10.1.72, 1 200 000 units, 2018-2021"


def test_findings():
    found = [(k, CV[s:e]) for s, e, k in personal_data.find_personal_data(CV, GIVEN)]
    assert found == [("name", "Zoë van der Luskazar"), ("email", "ZOE_L+JOBS@MAILBOX.EXAMPLE"), ("phone", "+44 7700 900123 ext. 12"), ("address", "Flat 6A, 75 Rookery Street, Corvale XV29 3AQ"), ("id_number", "00967-2385054-4"), ("name", "Lubna Savquist")]


def test_surrogates_keep_identity_and_form(spark):
    rows = [(1, CV, "p"), (1, CV, "q"), (2, "Signed: Lubna Savquist\r\nlubna (at) post.test, +44 7700 900123", None), (3, None, None), (4, " ", None), (5, "1 " * 50_000 + "@" * 5000 + "a." * 20_000, None), (None, "Signed: Haruto Ardley", "r")]
    df = spark.createDataFrame(rows, "id long, t string, redacted string")
    out = [r.asDict() for r in personal_data.pseudonymise(df, "id", "t", KEY, lexicon(spark)).collect()]
    assert len(out) == len(rows)
    by = {r["id"]: r for r in out}
    assert by[3]["redacted"] is None and by[4]["redacted"] == " " and by[None]["redacted"] == "Signed: [NAME]"
    assert "[NAME]" in by[1]["redacted"] and "Savquist" not in by[1]["pseudonymised"] and by[1]["n_found"] == 6
    name = by[2]["pseudonymised"].split("\r\n")[0].removeprefix("Signed: ")
    assert name in by[1]["pseudonymised"] and len(name.split()) == 2 and name.istitle()
    assert personal_data.surrogate("k", "name", "ZOË LUSK", {}).isupper() and personal_data.surrogate("k", "phone", "+44 (0)7700-900123", {})[:2] == "+4"[:1] + personal_data.surrogate("k", "phone", "+44 (0)7700-900123", {})[1]


def test_colliding_surrogates_are_parted(spark, monkeypatch):
    # All e-mail addresses of one salt share a surrogate: each must get a salt of its own, and forms of one address share theirs.
    monkeypatch.setattr(personal_data, "core", lambda secret, kind, form, salt, gender="": f"{kind} {salt}")
    found = spark.createDataFrame([("email", "a@b.test"), ("email", "c@d.test"), ("email", "a (at) b.test"), ("email", "e@f.test")], "pii_type string, pii_value string")
    salts = {r["identity"]: r["salt"] for r in personal_data.colliding(found, KEY).collect()}
    parts = [personal_data.parts_of(r[0], r[1])[0] for r in found.collect()]
    assert parts[0] == parts[2] and sorted(salts.get(i, 0) for i in {p[1] for p in parts}) == [0, 1, 2]


def _many(kind, n):
    rng = random.Random(len(kind))
    word = lambda k: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(k)).capitalize()
    make = {
        "email": lambda i: f"{word(3).lower()}.{i}@{word(2).lower()}.test", "phone": lambda i: f"+44 7700 9{i:05d}", "id_number": lambda i: f"AB {i // 10000 % 100:02d} {i // 100 % 100:02d} {i % 100:02d} C",
        "address": lambda i: f"{i} High Street, Leeds LS{i % 9} {i % 7}AB", "name": lambda i: f"{word(2)} {word(4)}",
    }[kind]
    return sorted({make(i) for i in range(n)})


@pytest.mark.parametrize("kind", personal_data.TYPES)
def test_ten_thousand_values_stay_apart(spark, kind):
    values = _many(kind, 10_000)
    found = spark.createDataFrame([(v, kind, "") for v in values], "pii_value string, pii_type string, gender string")
    made = {r["pii_value"]: r["surrogate"] for r in personal_data.with_surrogates(found, KEY).collect()}
    assert len(made) == len(values) > 9_000
    assert len({personal_data.normal(kind, x) for x in made.values()}) == len({personal_data.normal(kind, v) for v in values})
    assert sum(made[v] == v for v in values) == 0


def test_form_of_surrogates():
    make = lambda kind, v: personal_data.surrogate(KEY, kind, v, {})
    assert make("phone", "+44 7700 900123 ext. 12").startswith("+44 ") and make("phone", "0049-30-1234567").startswith("0049-") and make("phone", "+1 (652) 555-0175")[:4] == "+1 (" and make("phone", "0171 2345678")[0] == "0"
    nino, dni, rut = make("id_number", "AB123456C"), make("id_number", "12345678Z"), make("id_number", "12.345.678-5")
    assert nino[:2] != "AB" and nino[-1] in "ABD" and dni[-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(dni[:8]) % 23]
    body = [int(c) for c in rut[:-2] if c.isdigit()][::-1]
    check = 11 - sum(d * (2 + i % 6) for i, d in enumerate(body)) % 11
    assert rut[-1] == {11: "0", 10: "K"}.get(check, str(check)) and rut[2] == "." and rut[-2] == "-"
    address = make("address", "Flat 6A, 75 Rookery Street, Corvale XV29 3AQ")
    assert address.startswith("Flat ") and " Street, " in address and "XV" not in address and not address.endswith("AQ") and "Corvale" not in address


@pytest.mark.parametrize("text, name, low, high", [("ФИО: Иван Петров", "Иван Петров", 0x400, 0x52F), ("Name: Νίκος Παπαδόπουλος", "Νίκος Παπαδόπουλος", 0x370, 0x3FF), ("الاسم: محمد السيد", "محمد السيد", 0x600, 0x6FF), ("姓名：王小明", "王小明", 0x4E00, 0x9FFF), ("이름: 김민준", "김민준", 0xAC00, 0xD7A3), ("氏名: タナカハナコ", "タナカハナコ", 0x30A0, 0x30FF)])
def test_names_in_other_scripts(text, name, low, high):
    (start, end, kind), = personal_data.find_personal_data(text + "\nx", GIVEN)
    assert (text[start:end], kind) == (name, "name")
    made = personal_data.surrogate(KEY, "name", name, {})
    assert made != name and all(low <= ord(c) <= high for c in made if c != " ") and made.count(" ") == name.count(" ")


def test_surnames_before_given_names_however_long():
    long = "Lusk" * 40
    text = f"met van der {long}, Haruto B. today"
    assert [text[s:e] for s, e, _ in personal_data.find_personal_data(text, GIVEN)] == [f"van der {long}, Haruto B."]


def test_a_weak_key_is_refused(spark):
    found = spark.createDataFrame([("x@y.test", "email", "")], "pii_value string, pii_type string, gender string")
    for key in ("", "short", None):
        with pytest.raises(ValueError):
            personal_data.with_surrogates(found, key)


def test_a_long_lexicon_is_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, CV), (2, None), (3, "seen: Haruto Ardley")], "id long, t string")
    rows = lambda: sorted(map(tuple, personal_data.detect(df, "id", "t", lexicon(spark)).collect()))
    want = rows()
    monkeypatch.setattr(personal_data, "LEXICON_BROADCAST", 1)
    assert rows() == want and len(want) == 7


def _emitted(found, salts):
    return [personal_data.normal(k, personal_data.surrogate("k", k, v, salts)) for k, v in found]


def test_addresses_of_one_town_stay_apart_as_written_out(spark):
    # Ninety numbers of two digits meet eighty-one surrogates of the town: a part must leave it, and is checked again.
    values = [("address", f"PO Box {i}, Saltwyn") for i in range(10, 100)] + [("phone", f"+0{i} 0000 0000") for i in range(10, 30)]
    values += [("email", f"p{i} at mail dot test") for i in range(300)] + [("email", f"p{i}@mail.test") for i in range(300)]
    found = spark.createDataFrame(values, "pii_type string, pii_value string")
    salts = {(r["kind"], r["identity"]): r["salt"] for r in personal_data.colliding(found, "k").collect()}
    identities = len({personal_data.parts_of(k, v)[0] for k, v in values})
    assert identities == 90 + 20 + 300
    assert len(set(_emitted(values, {}))) < identities and len(set(_emitted(values, salts))) == identities


def test_a_second_clash_is_parted_and_too_few_surrogates_are_told(spark):
    # "Ay" is too short for a made-up word: nine surrogates for nine numbers are found only by salting again and again.
    nine = spark.createDataFrame([("address", f"PO Box {i}, Ay") for i in range(1, 10)], "pii_type string, pii_value string")
    salts = {(r["kind"], r["identity"]): r["salt"] for r in personal_data.colliding(nine, "k").collect()}
    assert len(set(_emitted([tuple(r) for r in nine.collect()], salts))) == 9 and max(salts.values()) > 1


def test_initials_stay_apart_and_rows_without_key_are_salted(spark):
    names = [f"{c}. Savquist" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    assert len({personal_data.surrogate("k", "name", n, {}) for n in names}) == 26
    df = spark.createDataFrame([(None, f"PO Box {i}, Saltwyn") for i in range(10, 100)], "id long, t string")
    assert len({r["pseudonymised"] for r in personal_data.pseudonymise(df, "id", "t", KEY, lexicon(spark)).collect()}) == 90


def test_a_name_has_one_surrogate_with_and_without_a_title(spark):
    texts = ["Reported to Mr Haruto Vance", "Signed: Haruto Vance", "Signed: Haruto Ardley", "Reported to Ms Haruto Vance\nReference: Mr Haruto Vance", "Reported to Mr Lubna Vance", "Signed: Zoë Vance"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    out = {r["id"]: r["pseudonymised"] for r in personal_data.pseudonymise(df, "id", "t", KEY, lexicon(spark)).collect()}
    given = {personal_data.given_of(out[i][s:]) for i, s in ((0, len("Reported to Mr ")), (1, len("Signed: ")), (2, len("Signed: ")))}
    assert len(given) == 1 and given.pop().endswith(personal_data._ENDINGS["latin"]["m"])
    assert len({line.split(" ", 3)[-1] for line in out[3].replace("Reference:", "Reported to").split("\n")}) == 1
    assert personal_data.given_of(out[4][len("Reported to Mr "):]).endswith(personal_data._ENDINGS["latin"]["m"])


def test_given_names_are_learned(spark):
    df = spark.createDataFrame([("Name: Zoë Lusk",), ("my name is zoë lusk and I was born",), ("Signed: Harlan Vance Ltd",), (None,)], "t string")
    assert {r["given"] for r in personal_data.learn_given_names(df, "t").collect()} == {"zoë"}
    assert personal_data.learn_given_names(df.limit(0), "t").count() == 0


# -- consensus -------------------------------------------------------------------------------------------------


def test_consensus_recovers_bands(spark):
    rng = np.random.default_rng(1)
    t = rng.uniform(0, 100, 3000)
    cols = [t + rng.normal(0, 4, 3000), (t + rng.normal(0, 5, 3000)) / 10, 100 - t + rng.normal(0, 4, 3000), rng.uniform(0, 100, 3000)]
    cols = [np.clip(c, 0, 100) for c in cols]
    rows = [(i, "p", *[None if rng.random() < 0.1 else float(c[i]) for c in cols]) for i in range(3000)]
    rows += [(8000 + i, "same", 5.0, 5.0, 5.0, None) for i in range(3)]
    rows += [(9001, "p", 50.0, None, None, None), (9002, "p", 500.0, -3.0, float("nan"), 50.0), (9003, None, 80.0, 8.0, 20.0, None)]
    df = spark.createDataFrame(rows, "key int, panel string, a double, b double, c double, d double")
    items, people, panels = consensus.consensus(df, "key", "panel", ["a", "b", "c", "d"])
    got = {r["key"]: r["band"] for r in items.collect()}
    assert 9001 not in got and 9002 not in got and 9003 in got
    want = {i: "strong" if x >= 70 else "moderate" if x >= 40 else "weak" for i, x in enumerate(t)}
    shared = [i for i in want if i in got]
    assert sum(got[i] == want[i] for i in shared) > 0.88 * len(shared)
    skill = {r["r"]: r["skill"] for r in people.where("panel = 'p'").collect()}
    assert min(skill[0], skill[1], skill[2]) > 0.7 and skill[3] < 0.2
    assert 0 < panels.where("panel = 'p'").first()["agreement"] < 1


def test_consensus_of_nothing(spark):
    df = spark.createDataFrame([], "k int, p string, a double, b double, c double, d double")
    assert [x.count() for x in consensus.consensus(df, "k", "p", ["a", "b", "c", "d"])] == [0, 0, 0]


# -- spam pages ------------------------------------------------------------------------------------------------

PROSE = "For {n} years I have worked with the team and we wrote about {w} because the readers asked for it. It was not easy, but they told us that it helped them with their own work on {w2}."


def page(i, rng):
    kind = i % 4
    words = ["ledger", "harbour", "lantern", "orchard", "quarry", "saddle", "timber", "violet", "walnut", "meadow"]
    if kind == 0:
        return " ".join(f"http://site{rng.randrange(99)}.example/{rng.choice(words)}-{rng.randrange(999)}" for _ in range(40)), True
    if kind == 1:
        w = rng.choice(words)
        return " ".join(rng.choice([f"best {w} jobs", f"cheap {w}", f"{w} {w} salary"]) for _ in range(40)), True
    return " ".join(PROSE.format(n=rng.randrange(30), w=rng.choice(words), w2=rng.choice(words)) for _ in range(4)), False


def test_spam_pages(spark):
    rng = random.Random(2)
    pages = [page(i, rng) for i in range(200)]
    rows = [(i, t, "h1" if i % 3 else None, 0.5) for i, (t, _) in enumerate(pages)] + [(500, None, "h1", 0.1), (501, "", "h2", 0.1), (502, "two words", None, 0.1), (503, "#a " * 40_000, "h1", 0.1), (0, pages[0][0], "h1", 0.2)]
    df = spark.createDataFrame(rows, "doc int, t string, h string, score double")
    out = {r["doc"]: r["smoothed"] for r in spam_pages.score_pages(df, "doc", "t", "h").collect()}
    assert all((out[i] > 0.5) == spam for i, (_, spam) in enumerate(pages)) and out[500] == out[501] == out[502] == 0 and out[503] > 0.5


RUSSIAN = "Я работаю в этой компании уже восемь лет и отвечаю за развитие команды. Мы вместе построили новую систему учёта, которая помогла сотрудникам быстрее находить документы. Сначала было трудно, потому что данные хранились в разных местах, но постепенно всё наладилось."
POLISH = "Od ośmiu lat pracuję w tej firmie i odpowiadam za rozwój zespołu. Razem zbudowaliśmy nowy system ewidencji, który pomógł pracownikom szybciej znajdować dokumenty. Na początku było trudno, ponieważ dane leżały w różnych miejscach, ale z czasem wszystko się ułożyło."


def test_prose_of_other_languages(spark):
    rng = random.Random(4)
    rows = [(i, page(i, rng)[0], "h") for i in range(200)] + [(900, RUSSIAN, "h"), (901, POLISH, "h"), (902, "".join(f'<a href="/j{i}">apply</a> ' for i in range(40)), "h")]
    out = {r["doc"]: r["smoothed"] for r in spam_pages.score_pages(spark.createDataFrame(rows, "doc int, t string, h string"), "doc", "t", "h").collect()}
    assert out[900] < 0.5 and out[901] < 0.5 and out[902] > 0.5


def test_function_words_are_learned(spark):
    words = RUSSIAN.replace(".", "").replace(",", "").split()
    rng = random.Random(5)
    pages = [(" ".join(rng.choice(["и", "в", "за", "но"]) + " " + rng.choice(words) + " слово" + "".join(rng.choices("абвгдежзик", k=4)) + ("." if j % 7 == 0 else "") for j in range(20)),) for i in range(40)]
    function, common = spam_pages.learn_words(spark.createDataFrame(pages + [(PROSE.format(n=1, w="a", w2="b"),), (PROSE.format(n=2, w="c", w2="d"),)], "t string"), "t")
    assert {"и", "в", "за", "но"} <= function and "worked" in common and "и" not in common


def test_spam_pages_without_labels(spark):
    df = spark.createDataFrame([(1, PROSE.format(n=1, w="a", w2="b"), None)], "doc int, t string, h string")
    assert spam_pages.score_pages(df, "doc", "t", "h").first()["smoothed"] == 0
    assert spam_pages.score_pages(df.limit(0), "doc", "t", "h").count() == 0
