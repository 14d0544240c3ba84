"""Personal data in free text: detection by type, and keyed surrogates that keep type, form, script and identity.

Addresses, e-mail addresses, identity numbers and phone numbers have forms. Names don't; they are found next to the words
that announce one and by their given name, with a lexicon of given names learned from announced names
over the whole table. What is found gets a surrogate of its kind; different values keep different surrogates.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaeflow.operators.joins import join_lookup
from vitaeflow.sources.scratch import cut_lineage, is_small

#: Given names up to which the lexicon is sent to the tasks; a longer one is joined to the words of each text.
LEXICON_BROADCAST = 500_000
#: A word is a given name where at least this part of its occurrences are announced as one.
GIVEN_SHARE = 0.1
#: Letters a key of the surrogates must have.
LEAST_KEY = 8
TYPES = ("address", "email", "id_number", "phone", "name")

# By rule: cased letters of Latin, Greek, Cyrillic and Armenian; then ranges of scripts without case that part words by blanks.
_CASED = [chr(c) for c in (*range(0x41, 0x58B), *range(0x1E00, 0x2000)) if chr(c).isalpha()]
_UP, _LO = "".join(c for c in _CASED if c.isupper()), "".join(c for c in _CASED if c.islower())
_L = _UP + _LO + "א-תء-يऄ-ॣ"
_HAN = "一-鿿぀-ヿ가-힣"
_GAP = r"[ \t ]"
_EMAIL = re.compile(
    rf"(?<![\w.+-])[{_L}\d](?:[{_L}\d._%+-]*[{_L}\d])?(?:{_GAP}*@{_GAP}*|{_GAP}*[(\[{{]{_GAP}*(?:at|AT|At)\s*[)\]}}]{_GAP}*|{_GAP}+(?:at|AT){_GAP}+(?=[\w-]+{_GAP}+(?:dot|DOT){_GAP}))"
    rf"[{_L}\d-]+(?:(?:\.|{_GAP}*[(\[{{](?:dot|DOT)[)\]}}]{_GAP}*|{_GAP}+(?:dot|DOT){_GAP}+)[{_L}\d-]+)*(?:\.|{_GAP}*[(\[{{](?:dot|DOT)[)\]}}]{_GAP}*|{_GAP}+(?:dot|DOT){_GAP}+)[{_L}]{{2,}}(?![\w@])"
)
# Forms of identity numbers.
_ID = re.compile(
    r"(?<![\w.+-])(?:\d{5}-\d{7}-\d|\d{3}([- ])\d{2}\1\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{7,8}|\d{1,2}\.\d{3}\.\d{3}-[\dKk]|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]\d{7}[A-Z])(?![\w-]|\.\w)"
)
_ID_LABEL = re.compile(r"(?i)\b(?:ssn|nino?|ni number|ni no\.?|tax id|national id|id card|identity number|id(?:entity)? (?:no\.?|number)|cnic|passport(?: no\.?| number)?|dni|nie|rut|personal number)\b\s*(?:is|:|no\.?|#|-)?\s*([A-Z0-9][A-Z0-9 .-]{4,18}[A-Z0-9])")
_PHONE = re.compile(
    rf"(?<![\w.@/-])(?<!\d[ .])(?:\+{_GAP}?\d{{1,3}}|00\d{{1,3}})?{_GAP}?[-.–]?(?:\(\d{{1,5}}\)|\d)(?:[ \t .–‑/-]?(?:\(\d{{1,5}}\)|\d)){{7,14}}(?:,?{_GAP}*(?:ext\.?|extension|x|Ext\.?|EXT\.?){_GAP}*\d{{1,6}})?(?![\w-])"
)
_NUMBER_WORD = re.compile(r"(?i)(?:part|ticket|order|invoice|build|version|serial|ref(?:erence)?|case|isbn|account|model|item|budget\D{0,20}|from|to)\s*(?:no\.?|number|id|#|:)?\s*$")
# Words of streets.
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Close|Court|Ct\.?|Drive|Dr\.?|Way|Place|Pl\.?|Square|Sq\.?|Terrace|Crescent|Gardens|Grove|Boulevard|Blvd\.?|Row|Walk|Hill|Park|Mews|Parade|Quay|Yard)"
_NAME_WORD = rf"[{_UP}][{_L}'’]*(?:-[{_L}][{_L}'’]*)*\.?"
_TOWN = rf"[{_UP}][{_L}'’]+(?:-[{_L}'’]+)*(?![{_L}\d])(?:{_GAP}(?:(?:on|upon|de|la|del|am|an|der|le|les|sur){_GAP})*[{_UP}][{_L}'’]+(?:-[{_L}'’]+)*(?![{_L}\d])){{0,2}}"
_CODE = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}|(?:[A-Z]{2} )?\d{5}(?:-\d{4})?)"
_UNIT = rf"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room|FLAT|APT|UNIT){_GAP}*\.?\#?{_GAP}*\d{{0,4}}{_GAP}?[A-Za-z]?\d{{0,3}},?{_GAP}+)?"
_SEP = rf"(?:,?{_GAP}*(?:\r\n|\n|\r){_GAP}*|,{_GAP}*|{_GAP}+)"
_ADDRESS = re.compile(
    "|".join((
        rf"(?:PO|P\.O\.|P\.{_GAP}O\.|Po){_GAP}?(?:Box|BOX){_GAP}*\d{{1,6}}(?:{_SEP}{_CODE}{_GAP})?{_SEP}{_TOWN}(?:,?{_GAP}+{_CODE})?",
        rf"{_UNIT}\d{{1,5}}[A-Za-z]?,?{_GAP}+(?:{_NAME_WORD}{_GAP}+){{1,3}}(?i:{_STREET})(?![{_L}]){_SEP}{_TOWN}(?:,?{_GAP}+{_CODE})?",
        rf"(?:{_UNIT}\d{{1,5}}(?:{_GAP}?(?:bis|ter))?,?{_GAP}+(?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai)(?:{_GAP}+(?:de|du|des|la|le|les|l['’]))*{_GAP}+(?:{_NAME_WORD}{_GAP}?){{1,3}}){_SEP}\d{{5}}{_GAP}+{_TOWN}",
        rf"(?i:calle|avenida|avda\.?|c/|plaza|paseo|camino|ronda)(?:{_GAP}+(?:de|del|la|las|los))*{_GAP}+(?:{_NAME_WORD}{_GAP}+){{0,2}}{_NAME_WORD},?{_GAP}+\d{{1,5}}(?:,{_GAP}*\d{{1,2}}\.?[ºª°]?{_GAP}?[A-Za-z]{{0,4}})?{_SEP}\d{{5}}{_GAP}+{_TOWN}",
        rf"(?:{_NAME_WORD}{_GAP}+){{0,2}}[{_UP}][{_L}'’-]*(?i:str\.|straße|strasse|weg|gasse|platz|allee|ring|damm|ufer){_GAP}+\d{{1,5}}{_GAP}?[a-zA-Z]?{_SEP}\d{{5}}{_GAP}+{_TOWN}",
    ))
)
_PARTICLE = r"(?:van der|van den|van de|van|von der|von|de la|de los|de|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ter|ten|zu|af|VAN DER|VAN|VON|DE LA|DE|DI|DA|DU|DEL)"
_WORD = rf"[{_L}][{_L}'’]*(?:-[{_L}][{_L}'’]*)*"
_PART = rf"(?:[{_L}]\.(?:{_GAP}?[{_L}]\.)?|{_WORD})"
#: A name as written: "Surname, Given" or given name or initial, up to two more parts, particles, surname.
_NAME = rf"(?:(?:{_PARTICLE}{_GAP}+)?{_WORD},{_GAP}+{_PART}(?:{_GAP}+[{_L}]\.)?|{_PART}(?:{_GAP}+[{_L}]\.|{_GAP}+(?!{_PARTICLE}{_GAP}){_WORD}(?={_GAP}+{_WORD}))?(?:{_GAP}+{_PARTICLE})?{_GAP}+{_WORD})"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Frau|Sr|Sra|Mme|M)\.?[ \t]+)?"
#: What announces a name, and what may follow it.
_ANNOUNCED = re.compile(
    rf"(?im)(?:^[ \t]*(?:(?:full |candidate |applicant )?name|candidate|applicant|nombre|nom|имя|фио|όνομα|الاسم|שם|नाम)[ \t]*(?::|-|–|is)[ \t]*|\b(?:resume|cv|curriculum vitae|lebenslauf) (?:of|for|von)[ \t]+|^[ \t]*(?:signed|signature|reference|referee|emergency contact|contact person|next of kin)[ \t]*:[ \t]*"
    rf"|\bmy name is[ \t]+|\bnext of kin:[ \t]*|\b(?:reported|reporting|reports) to[ \t]+|\bmy (?:supervisor|manager|boss|referee|mentor)(?:[ \t]+is)?[ \t]+){_TITLE}"
    rf"(?P<name>(?-i:{_NAME}))(?=[ \t]*(?:$|[;,.(\[|\r\n/]|[ \t](?:and|at|from|of|on|in|who|will|can)\b))"
)
_TITLED = re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Frau)\.?[ \t]+(?P<name>{_NAME})")
#: Names in scripts without blanks between words, after a label.
_HAN_NAME = re.compile(rf"(?m)(?:姓名|氏名|名前|이름|성명|[Nn]ame)[ \t]*[:：][ \t]*(?P<name>[一-鿿]{{2,4}}|[゠-ヿ・]{{3,14}}|[가-힣]{{2,4}})(?![{_HAN}])")
_LINE_NAME = re.compile(rf"^[ \t]*(?P<name>[{_UP}]\.(?:{_GAP}?[{_UP}]\.)?(?:{_GAP}+{_PARTICLE})?{_GAP}+[{_UP}]{_WORD[len(f'[{_L}]'):]})[ \t]*$")
# Words that make a pair of words an organisation, a place or a prize.
_ORG = re.compile(rf"[ \t]*(?:&|(?:Ltd|Limited|Inc|LLC|GmbH|AG|S\.L\.|S\.A\.|PLC|Plc|Group|Holdings|Partners|Labs?|Systems|Works|Studio|Foods|Health|Energy|Logistics|Award|Prize|Medal|College|University|School|Institute|Polytechnic|Phase|Street|Road|Lane|Court|Foundation|Hospital|Trust|Bridge|Hall|Theorem|Method|Conference|Scholarship|Fellowship|Library|Centre|Center)\b)")
_LEGAL = re.compile(r"(?:Ltd|Limited|Inc|LLC|GmbH|AG|PLC|Plc)\.?$")
_NOT_NAME = re.compile(r"(?i)^(?:none|see|value|line|copied|checked|curriculum|resume|profile|summary|about|skills?|technical|core|work|experience|education|the|my|i|in|at|a|an|and|or|of|for|on|to|by|from|with|as|was|is|who|which|header|file|text|n/?a|unknown|redacted|name|address|email|phone)$")


def given_of(name: str) -> str | None:
    """The given name of a written name, lower case; None where it is an initial."""
    first = name.split(",")[1] if "," in name else name
    word = _BLANKS.split(first.strip())[0]
    return None if len(word.rstrip(".")) < 2 or word.endswith(".") else word.lower()


_BLANKS, _PARTS = re.compile(r"[ \t\u00a0]+"), re.compile(r"[ \t\u00a0,]+")


def announced(text: str) -> list[tuple[int, int]]:
    """Spans of names after words that announce one."""
    out = []
    for pattern in (_ANNOUNCED, _TITLED):
        for m in pattern.finditer(text):
            words = _PARTS.split(m["name"])
            if not any(_NOT_NAME.match(w) or _LEGAL.match(w) for w in words) and not _ORG.match(text, m.end("name")):
                out.append(m.span("name"))
    if not text.isascii():
        out += [m.span("name") for m in _HAN_NAME.finditer(text)]
    return out


_TOKEN = re.compile(rf"(?<![\w@.+'’]){_WORD}")
#: What may follow a given name: an initial, a particle, a surname.
_FOLLOWS = re.compile(rf"(?:{_GAP}+[{_L}]\.(?=[ \t\u00a0]))?(?:{_GAP}+{_PARTICLE}(?={_GAP}))?{_GAP}+(?P<s>{_WORD})")
_COMMA, _ONLY_GAP, _INITIAL = re.compile(rf",{_GAP}+"), re.compile(rf"{_GAP}+"), re.compile(rf"{_GAP}+[{_L}]\.(?!\w)")
_PARTICLE_ONLY = re.compile(_PARTICLE)


def names_in(text: str, given: frozenset[str] | set[str], whole_value: bool = False) -> list[tuple[int, int]]:
    """Spans of names: announced ones, those with a known given name, and an initial with a surname in a line of its own at the top."""
    spans = announced(text)
    tokens = list(_TOKEN.finditer(text))
    at = 0
    for i, w in enumerate(tokens):
        if w.start() < at or w[0].lower() not in given:
            continue
        # Given name first: further parts, particles and a surname after it; or a surname and a comma before it.
        m = _FOLLOWS.match(text, w.end())
        span = None
        if m and _surname_fits(w[0], m["s"]) and not _ORG.match(text, m.end()):
            span = (w.start(), m.end())
        elif i and _COMMA.fullmatch(text, tokens[i - 1].end(), w.start()) and text[tokens[i - 1].start() - 1 : tokens[i - 1].start()] != "-" and _surname_fits(w[0], tokens[i - 1][0]):
            start = _with_particle(text, tokens, i - 1)
            initial = _INITIAL.match(text, w.end())
            span = (start, initial.end() if initial else w.end())
        if span:
            spans.append(span)
            at = span[1]
    head = 0
    for line in re.finditer(r"[^\r\n]+", text):
        if line[0].strip():
            head += 1
            if head > (1 if whole_value else 2):
                break
            if m := _LINE_NAME.match(line[0]):
                spans.append((line.start() + m.start("name"), line.start() + m.end("name")))
    return spans


def _with_particle(text: str, tokens: list[re.Match], i: int) -> int:
    """Where the surname at token ``i`` starts, with the particle of up to three words before it."""
    for n in (3, 2, 1):
        if i >= n and _PARTICLE_ONLY.fullmatch(text, tokens[i - n].start(), tokens[i - 1].end()) and _ONLY_GAP.fullmatch(text, tokens[i - 1].end(), tokens[i].start()):
            return tokens[i - n].start()
    return tokens[i].start()


def _surname_fits(given: str, surname: str) -> bool:
    """Written alike: both capitalised, both lower case or both in capitals."""
    if _NOT_NAME.match(surname) or len(surname) < 3:
        return False
    return given[0].isupper() == surname[0].isupper()


_WRAP_HEAD = re.compile(r"\s*(?:(?:value|copied from the file|line \d+|see|found|text)\s*[:,]\s*)?", re.I)
_WRAP_TAIL = re.compile(r"\s*(?:\((?:see|from|in) [^()]*\)|;\s*checked.*|,\s*see .*)?\s*$", re.I)
_PART_NUMBER = re.compile(r"(?i)(?:part|ticket|order|invoice|build|serial|model)\s*(?:no\.?|number|#|:)?\s*$")
_EXTENSION = re.compile(r"(?i),?\s*(?:ext|x)")
_NO_PHONE = re.compile(r"(?:19|20)\d\d[-–/ ]+(?:19|20)\d\d|\d{1,3}(?: \d{3})+|\d{4}-\d\d-\d\d.*")


def _wrapped(text: str) -> tuple[str, int]:
    """A label value without the words wrapped around it, and how many letters were cut before it."""
    m, end = _WRAP_HEAD.match(text), _WRAP_TAIL.search(text)
    return text[m.end() : max(m.end(), end.start())], m.end()


def find_personal_data(text: str, given: frozenset[str] | set[str], whole_value: bool = False) -> list[tuple[int, int, str]]:
    """Sorted, disjoint ``(start, end, type)``. ``whole_value``: the text is a single label value."""
    taken: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        while end > start and text[end - 1] in " \t\r\n ,;:|":
            end -= 1
        if end > start and all(end <= s or start >= e for s, e, _ in taken):
            taken.append((start, end, kind))

    for m in _EMAIL.finditer(text):
        add(*m.span(), "email")
    for m in _ADDRESS.finditer(text):
        add(*m.span(), "address")
    for m in _ID.finditer(text):
        if not _PART_NUMBER.search(text[max(0, m.start() - 20) : m.start()]):
            add(*m.span(), "id_number")
    for m in _ID_LABEL.finditer(text):
        if sum(c.isdigit() for c in m[1]) >= 5:
            add(*m.span(1), "id_number")
    for m in _PHONE.finditer(text):
        start, end = m.span()
        while text[start] in " \t -.–":
            start += 1
        value = _EXTENSION.split(text[start:end])[0]
        digits = sum(c.isdigit() for c in value)
        if 9 <= digits <= 15 and not _NUMBER_WORD.search(text[max(0, start - 30) : start]) and not _NO_PHONE.fullmatch(value):
            add(start, end, "phone")
    for start, end in names_in(text, given, whole_value):
        add(start, end, "name")
    return sorted(taken)


def learn_given_names(df: DataFrame, text: str) -> DataFrame:
    """``given``: the words that are announced as given names in at least ``GIVEN_SHARE`` of their occurrences, over all texts.

    Shares don't depend on the size of the table. Words are counted within a batch before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, total = Counter(), Counter()
            texts = [t for t in batch.column(0).to_pylist() if t]
            for t in texts:
                told.update(g for s, e in announced(t) if (g := given_of(t[s:e])))
            for t in texts:
                total.update(_EVERY_WORD.findall(t.lower()))
            words = list(told.keys() | total.keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([told[w] for w in words], pa.int64()), pa.array([total[w] for w in words], pa.int64())], ["given", "told", "total"])

    counts = df.select(text).mapInArrow(run, "given string, told bigint, total bigint").groupBy("given").agg(F.sum("told").alias("told"), F.sum("total").alias("total"))
    return cut_lineage(counts.where((F.col("told") > 0) & (F.col("told") >= GIVEN_SHARE * F.col("total"))).select("given"))


_EVERY_WORD = re.compile(_WORD)


def _lexicon_of(rows: DataFrame, given: DataFrame) -> tuple[DataFrame, Callable[[list | None], frozenset[str] | set[str]]]:
    """``rows`` (row_key, t) with ``own``, and what turns ``own`` into the given names that count in a text.

    A lexicon of at most ``LEXICON_BROADCAST`` names goes to all tasks; of a longer one each text gets the names among its words, by a join.
    """
    if is_small(given, LEXICON_BROADCAST):
        names = rows.sparkSession.sparkContext.broadcast(frozenset(r["given"] for r in given.collect()))
        return rows.withColumn("own", F.lit(None).cast("array<string>")), lambda own: names.value
    texts = rows.select("t").where("t is not null").distinct().withColumn("h", F.sha2("t", 256))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(h, w) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in {x[0].lower() for x in _TOKEN.finditer(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(2)], ["h", "given"])

    own = texts.select("h", "t").mapInArrow(words, "h string, given string").join(given, "given").groupBy("h").agg(F.collect_set("given").alias("own"))
    return rows.withColumn("h", F.sha2("t", 256)).join(own, "h", "left").drop("h"), lambda own: set(own or ())


def detect(df: DataFrame, key: str, text: str, given: DataFrame, whole_value: bool = False) -> DataFrame:
    """``row_key string, hash string, start int, stop int, pii_type string, pii_value string, gender string``: every finding of every
    row; offsets in characters, ``hash`` of the text, ``gender`` as a title before a name tells it, else empty.

    Null and blank texts have none. Rows are independent; nothing is shuffled while the lexicon ``given`` is small.
    """
    schema = "row_key string, hash string, start int, stop int, pii_type string, pii_value string, gender string"
    rows, names = _lexicon_of(df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("t")), given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t, h, own in zip(*(batch.column(c).to_pylist() for c in ("row_key", "t", "hash", "own"))):
                if not t or not t.strip():
                    continue
                inner, cut = _wrapped(t) if whole_value else (t, 0)
                for s, e, kind in find_personal_data(inner, names(own), whole_value):
                    title = _TITLE_BEFORE.search(inner[max(0, s - 8) : s]) if kind == "name" else None
                    out.append((k, h, s + cut, e + cut, kind, inner[s:e], _TITLE_GENDER.get(title[1].lower(), "") if title else ""))
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["row_key", "hash", "start", "stop", "pii_type", "pii_value", "gender"])

    return rows.select("row_key", "t", F.sha2("t", 256).alias("hash"), "own").mapInArrow(run, schema)


_TITLE_BEFORE = re.compile(r"(\w+)\.?[ \t]+$")
# The sounds surrogates are made of by script: what begins a syllable, what ends it.
_SOUNDS = {
    "latin": ("b br c cl d dr f fl g gr h j k l m n p pr r s st t tr v w z".split(), "a e i o u ai ea ie".split()),
    "greek": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ ψ κρ στ τρ".split(), "α ε η ι ο υ ω αι ει ου".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х ц ч ш бр др ст".split(), "а е и о у я ю ы".split()),
    "armenian": ("բ գ դ զ թ լ կ հ մ ն շ պ ս վ տ ր".split(), "ա ե ի ո օ է".split()),
    "hebrew": ("ב ג ד ה ז ח ט כ ל מ נ ס ע פ צ ק ר ש ת".split(), ["א", "ו", "י", ""]),
    "arabic": ("ب ت ث ج ح خ د ر ز س ش ص ط ع ف ق ك ل م ن ه".split(), ["ا", "و", "ي", ""]),
    "devanagari": ("क ख ग च ज ट ड त द न प ब म य र ल व श स ह".split(), ["ा", "ि", "ी", "ु", "े", "ो", ""]),
    "kana": ("カ キ ク サ シ ス タ ナ ニ ハ ヒ マ ミ ヤ ラ リ ロ ワ".split(), ["", "ン", "ー"]),
}
_SCRIPTS = (("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3))
# Endings of given names by script and gender.
_ENDINGS = {
    "latin": {"f": ("a", "ia", "elle", "ina"), "m": ("o", "us", "ard", "in"), "": ("en", "y", "is", "ey")},
    "greek": {"f": ("α", "η"), "m": ("ος", "ης"), "": ("ι", "ω")}, "cyrillic": {"f": ("а", "ия"), "m": ("он", "ир"), "": ("и", "о")},
}
_TITLE_GENDER = {"mr": "m", "herr": "m", "sr": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "sra": "f", "mme": "f"}
_KEPT = re.compile(rf"(?i)^(?:po|box|flat|apt|apartment|unit|suite|calle|avenida|rue|de|la|del|des|du|plaza|º|ª|{_STREET})$")
# Country calling codes of one and two digits; all others have three.
_CALLING = re.compile(r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
# Check letters of Spanish identity numbers, and letters British insurance numbers begin with.
_DNI, _NINO = "TRWAGMYFPDXBNJZSQVHLCKE", "ABCEGHJKLMNPRSTWXYZ"


def script_of(text: str) -> str:
    """The script of the first letter that isn't Latin, else ``latin``."""
    for c in text:
        if c > "\u036f":
            for name, low, high in _SCRIPTS:
                if low <= ord(c) <= high:
                    return name
    return "latin"


def _numbers(secret: str, *what: object) -> Iterator[int]:
    """A keyed stream of numbers for an identity."""
    n = 0
    while True:
        yield from hashlib.blake2b("\0".join(map(str, (*what, n))).encode(), key=secret.encode()[:64]).digest()
        n += 1


_AT, _DOT, _SIGNS = re.compile(r"(?i)\s*[(\[{]\s*at\s*[)\]}]\s*|\s*@\s*|\s+at\s+"), re.compile(r"(?i)\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+"), re.compile(r"[\W_]")
_WHOLE_PARTICLE, _PIECES = re.compile(rf"(?:{_PARTICLE})$"), re.compile(rf"[{_HAN}]+|{_WORD}")


def normal(kind: str, value: str) -> str:
    """A value without its written form: two values of a type with the same normal form say the same."""
    if kind == "email":
        return _DOT.sub(".", _AT.sub("@", value)).lower()
    return _SIGNS.sub("", value.lower())


def parts_of(kind: str, value: str) -> list[tuple[str, str]]:
    """What must stay distinct: ``(kind of part, identity)``; a name by given name and surnames, so that short and
    long forms of one name stay together."""
    if kind == "name":
        given = given_of(value)
        words = [w for w in _PIECES.findall(value) if not _WHOLE_PARTICLE.match(w) and len(w) > 1]
        return [("given" if w.lower() == given else "surname", w.lower()) for w in words]
    return [(kind, normal(kind, value))]


def _made_up(secret: str, kind: str, identity: str, salt: int, gender: str = "") -> str:
    n = _numbers(secret, kind, identity, salt)
    script = script_of(identity)
    if script in ("han", "hangul"):  # as many signs as the name has; by rule from the middle of the block
        low, size = (0x4E00, 0x5000) if script == "han" else (0xAC00, 11172)
        return "".join(chr(low + (next(n) * 256 + next(n)) % size) for _ in identity)
    onset, vowel = _SOUNDS[script]
    word = "".join(onset[next(n) % len(onset)] + vowel[next(n) % len(vowel)] for _ in range(2 if kind == "given" else 3))
    ending = _ENDINGS.get(script, {}).get(gender)
    if kind == "given":
        return word + (ending[next(n) % len(ending)] if ending else onset[next(n) % len(onset)])
    return word + (onset[next(n) % len(onset)] if script != "latin" else "n" if next(n) % 2 else "")


def _initial(secret: str, letter: str) -> str:
    """A keyed permutation of the letters of a script, so that two initials never become one."""
    same = lambda c: script_of(c) == script_of(letter) and c.isascii() == letter.isascii()
    letters = [c for c in _LO if same(c)]
    drawn = sorted(letters, key=lambda c: hashlib.blake2b(f"initial\0{c}".encode(), key=secret.encode()[:64]).digest())
    return drawn[letters.index(letter)] if letter in letters else letter


def _own_gender(given: str | None) -> str:
    """The gender of a given name that no title tells."""
    return "f" if given and given.endswith("a") else ""


def _redrawn(value: str, n: Iterator[int]) -> str:
    """Each digit and each letter replaced by one of its kind; an ASCII letter never stays."""
    def other(c: str) -> str:
        if c.isdigit():
            return str(next(n) % 10)
        base = "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else ""
        return chr(ord(base) + (ord(c) - ord(base) + 1 + next(n) % 25) % 26) if base else c

    return "".join(map(other, value))


def _identity_number(value: str, n: Iterator[int]) -> str:
    """Another number of the same form, with valid check letters and digits where the form has them."""
    made = _redrawn(value, n)
    plain = re.sub(r"[^0-9A-Za-z]", "", made)
    if re.fullmatch(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", value):
        return "".join(_NINO[next(n) % len(_NINO)] if i < 2 else c for i, c in enumerate(made[:-1])) + "ABCD"[("ABCD".index(value[-1]) + 1 + next(n) % 3) % 4]
    if re.fullmatch(r"\d{8}-?[A-Z]", value):
        return made[:-1] + _DNI[int(plain[:8]) % 23]
    if re.fullmatch(r"[XYZ]\d{7}[A-Z]", value):
        first = "XYZ"[next(n) % 3]
        return first + made[1:-1] + _DNI[int(str("XYZ".index(first)) + plain[1:8]) % 23]
    if re.fullmatch(r"\d{1,2}\.\d{3}\.\d{3}-[\dKk]", value):
        total = 11 - sum(int(d) * (2 + i % 6) for i, d in enumerate(reversed(plain[:-1]))) % 11
        return made[:-1] + ("0" if total == 11 else "K" if total == 10 else str(total))
    return made


def _phone(value: str, n: Iterator[int]) -> str:
    """The country code, leading zeros and all signs stay; a digit that isn't 0 at the number's start doesn't become 0."""
    head = re.match(r"\+\s?|00", value)
    keep = 0
    if head:
        digits = value[head.end() :]
        code = _CALLING.match(digits) or re.match(r"\d{3}", digits)
        keep = head.end() + (code.end() if code else 0)
    keep += re.match(r"[\s().-]*0*", value[keep:]).end()
    first = True

    def digit(m: re.Match) -> str:
        nonlocal first
        d, first = str(next(n) % 9 + 1 if first and m[0] != "0" else next(n) % 10), False
        return d

    return value[:keep] + re.sub(r"\d", digit, value[keep:])


def core(secret: str, kind: str, form: str, salt: int, gender: str = "") -> str:
    """The surrogate of a part as it is written out, in its normal form; two parts of a kind may not share it. A name's
    parts are words; of the other types ``form`` is the value as written."""
    if kind in ("given", "surname"):
        return _made_up(secret, kind, form, salt, gender)
    return normal(kind, surrogate(secret, kind, form, {parts_of(kind, form)[0]: salt}))


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


_EMAIL_PARTS = re.compile(r"(.*?)(\s*@\s*|\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+)(.*)", re.I | re.S)
_PLACE = re.compile(rf"(?P<code>{_CODE}(?![\w]))|\d\w*|[{_HAN}]+|{_WORD}")


def surrogate(secret: str, kind: str, value: str, salts: dict[tuple[str, str], int], genders: dict[str, str] | None = None) -> str:
    """A replacement of the same type, case, gender, script and format; ``genders`` has those of given names as they are settled
    over the table. Country codes stay, check letters and digits are valid, no letter of an identity number or post code stays."""
    salt = lambda part: salts.get(part, 0)
    if kind == "name":
        given = given_of(value)
        gender = (genders or {}).get(given, _own_gender(given))

        def word(m: re.Match) -> str:
            w = m[0]
            if _WHOLE_PARTICLE.match(w):
                return w
            if len(w) == 1:
                return _initial(secret, w.lower()).upper() if w.isupper() else _initial(secret, w.lower())
            part = ("given" if w.lower() == given else "surname", w.lower())
            return _cased(_made_up(secret, *part, salt(part), gender), w)

        return _PIECES.sub(word, value)
    part = parts_of(kind, value)[0]
    n = _numbers(secret, *part, salt(part))
    if kind == "email":
        local, at, domain = _EMAIL_PARTS.match(value).groups()
        made = _made_up(secret, *part, salt(part)) + str(next(n) % 10) + str(next(n) % 10)
        return (made.upper() if local.isupper() else made) + at + ("EXAMPLE.ORG" if domain.isupper() else "example.org")
    if kind == "address":
        def place(m: re.Match) -> str:
            w = m[0]
            if m["code"]:
                return _redrawn(w, n)
            if w[0].isdigit():
                return re.sub(r"\d", lambda _: str(next(n) % 9 + 1), w)
            return w if _KEPT.match(w) or (len(w) < 3 and w.isascii()) else _cased(_made_up(secret, "place", w.lower(), salt(part)), w)

        return _PLACE.sub(place, value)
    return _phone(value, n) if kind == "phone" else _identity_number(value, n)


#: Rounds of salting after which too many parts share too few surrogates of their form.
ROUNDS = 64


def settled_genders(found: DataFrame) -> DataFrame:
    """``kind, identity, told``: the gender that most titles before a given name tell, over all findings; none where they balance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(g, t) for v, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (g := given_of(v))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["identity", "told"])

    told = found.where("pii_type = 'name' and gender <> ''").select("pii_value", "gender").mapInArrow(run, "identity string, told string")
    votes = told.groupBy("identity").agg(F.sum(F.when(F.col("told") == "m", 1).otherwise(-1)).alias("m"))
    return votes.where("m <> 0").select(F.lit("given").alias("kind"), "identity", F.when(F.col("m") > 0, "m").otherwise("f").alias("told"))


def colliding(found: DataFrame, secret: str) -> DataFrame:
    """``kind, identity, salt, gender``: what the surrogates of parts need beyond the parts themselves. These are parts whose surrogate as written out another part of the kind has too, all but one of each
    such group, with a salt that parts them; and given names whose titles (column ``gender`` of ``found``, if it has one)
    tell another gender than their ending, so that a name has one surrogate with and without a title.

    What got a new salt is checked again with all others, until no two parts share a surrogate. A part that is written
    in several forms must differ in each of them, and moves as a whole.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({(*p, p[1] if k == "name" else v) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in parts_of(k, v)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "identity", "form"])

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [core(secret, *row) for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "form", "salt", "gender")))]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("identity"), batch.column("salt"), pa.array(out, pa.string())], ["kind", "identity", "salt", "core"])

    parts = found.select("pii_type", "pii_value").distinct().mapInArrow(forms, "kind string, identity string, form string").distinct()
    own = F.when((F.col("kind") == "given") & F.col("identity").endswith("a"), "f").otherwise("")
    if "gender" in found.columns:
        parts = parts.join(settled_genders(found), ["kind", "identity"], "left").withColumn("gender", F.coalesce("told", own)).drop("told")
    else:
        parts = parts.withColumn("gender", own)
    state = cut_lineage(parts.withColumn("salt", F.lit(0)))
    # Those of the lowest salt stay, so that what is settled doesn't move.
    taken = F.dense_rank().over(Window.partitionBy("kind", "core").orderBy("salt", "identity")) > 1
    for _ in range(ROUNDS):
        made = state.mapInArrow(emitted, "kind string, identity string, salt int, core string").distinct()
        moved = cut_lineage(made.withColumn("taken", taken).where("taken").select("kind", "identity", F.lit(1).alias("more")).distinct())
        if not moved.limit(1).count():
            return state.where((F.col("salt") > 0) | (F.col("gender") != own)).select("kind", "identity", "salt", "gender").distinct()
        state = cut_lineage(state.join(moved, ["kind", "identity"], "left").withColumn("salt", F.col("salt") + F.coalesce("more", F.lit(0))).drop("more"))
    raise ValueError(f"After {ROUNDS} rounds different values still share a surrogate: their form has too few surrogates.")


def with_surrogates(found: DataFrame, secret: str) -> DataFrame:
    """``found`` (a checkpoint of ``detect``) with ``surrogate``.

    Surrogates are made once per distinct value, whose parts carry what ``colliding`` settled, and go back to all
    findings by a join that bears hot values. ``secret`` has no default; one shorter than ``LEAST_KEY`` is refused.
    """
    if not secret or len(secret) < LEAST_KEY:
        raise ValueError(f"The key of the surrogates must have at least {LEAST_KEY} letters.")
    values = cut_lineage(found.groupBy("pii_type", "pii_value").agg(F.count("*").alias("n")))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, v, *p) for t, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in parts_of(t, v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["pii_type", "pii_value", "kind", "identity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, v, own in zip(*(batch.column(c).to_pylist() for c in ("pii_type", "pii_value", "salts"))):
                salt = {(x["kind"], x["identity"]): x["salt"] for x in own or ()}
                genders = {x["identity"]: x["gender"] for x in own or () if x["kind"] == "given"}
                out.append(surrogate(secret, t, v, salt, genders))
            yield pa.RecordBatch.from_arrays([batch.column("pii_type"), batch.column("pii_value"), batch.column("n"), pa.array(out, pa.string())], ["pii_type", "pii_value", "n", "surrogate"])

    salts = colliding(found.select("pii_type", "pii_value", "gender"), secret)
    of_value = values.select("pii_type", "pii_value").mapInArrow(parts, "pii_type string, pii_value string, kind string, identity string").join(salts, ["kind", "identity"])
    of_value = of_value.groupBy("pii_type", "pii_value").agg(F.collect_list(F.struct("kind", "identity", "salt", "gender")).alias("salts"))
    made = cut_lineage(values.join(of_value, ["pii_type", "pii_value"], "left").mapInArrow(run, "pii_type string, pii_value string, n bigint, surrogate string"))
    return join_lookup(found, made, ["pii_type", "pii_value"], "n")


def pseudonymise(df: DataFrame, key: str, text: str, secret: str, given: DataFrame) -> DataFrame:
    """``key, redacted, pseudonymised, n_found``: each row's text with typed placeholders, and with keyed surrogates.

    One identity has one surrogate wherever it occurs, and different ones stay different: parts whose
    surrogates collide as written out get a further number in their key, until none do. Null and blank texts come out as they are. A key that
    occurs in several rows is replaced in each of them. Texts are searched once; their findings are joined back by key and text.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    # A row is known by its key and its text, which settles what is found in it.
    rows = rows.withColumn("row_key", F.coalesce(F.concat(F.lit("k"), F.col("k").cast("string")), F.lit("-")))
    found = with_surrogates(cut_lineage(detect(rows, "row_key", "t", given).distinct()), secret)
    spans = found.groupBy("row_key", "hash").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "pii_type", "surrogate"))).alias("spans"))
    joined = rows.withColumn("hash", F.sha2("t", 256)).join(spans, ["row_key", "hash"], "left")

    def filled(with_what: str) -> F.Column:
        start = f"named_struct('s', '', 'at', 0)"
        step = f"(a, x) -> named_struct('s', concat(a.s, substring(t, a.at + 1, x.start - a.at), {with_what}), 'at', x.stop)"
        return F.expr(f"if(spans is null, t, aggregate(spans, {start}, {step}, a -> concat(a.s, substring(t, a.at + 1))))")

    return joined.select(F.col("k").alias(key), filled("'[', upper(x.pii_type), ']'").alias("redacted"), filled("x.surrogate").alias("pseudonymised"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_found"))
