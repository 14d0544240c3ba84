"""Contact data, degrees, years, dated experience, recency and evidence out of texts, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaeflow.functions.phrases import bound, first_that, holds, spaced

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: What stands before a number or link that begins there, then the number: international with its sign or zeros, or national with a leading zero.
PHONE = r"(^|[^0-9A-Za-z_+])((?:[+]|00)[1-9][0-9() .-]{6,20}[0-9]|0[0-9]{2,4}[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4})"
# Endings by which a host without a scheme is known.
HOST_ENDINGS = ("com", "org", "net", "io", "dev", "me", "ai", "co", "app", "tech", "info", "edu", "gov", "example", "test", "invalid")
_REST = r"[^\s<>'\"()]"
#: A link begins with a scheme, with www, or is a host of known ending, which isn't part of an address.
URL = rf"(?i)(^|[^@0-9A-Za-z_])(https?://{_REST}+|www\.{_REST}+|(?:[a-z0-9-]+\.)+(?:{'|'.join(HOST_ENDINGS)})\b(?:/{_REST}*)?)"


def emails(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), 1), F.lower)


def first_email(text: Column) -> Column:
    """The first address, lower case; else one with blanks around its sign."""
    spaced = F.regexp_replace(F.regexp_extract(text, r"([A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1), r"\s", "")
    return F.coalesce(F.try_element_at(emails(text), F.lit(1)), F.lower(F.nullif(spaced, F.lit(""))))


def first_phone(text: Column) -> Column:
    """The first number of 10 to 15 digits in a national or international form; no identity numbers or dates."""
    found = F.filter(F.regexp_extract_all(text, F.lit(PHONE), 2), lambda x: F.length(F.regexp_replace(x, r"\D", "")).between(10, 15) & ~x.rlike(r"^\d{5}-?\d{7}-?\d$"))
    return F.try_element_at(found, F.lit(1))


def links(text: Column) -> Column:
    """``struct<linkedin, github, other>``: the first link of each kind, without closing punctuation."""
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), 2), lambda x: F.regexp_replace(x, r"[.,;:)>\]'\"]+$", ""))
    kind = lambda cond: F.try_element_at(F.filter(found, cond), F.lit(1))
    in_li, in_gh = (lambda x: F.lower(x).contains("linkedin.com")), (lambda x: F.lower(x).contains("github.com"))
    return F.struct(kind(in_li).alias("linkedin"), kind(in_gh).alias("github"), kind(lambda x: ~in_li(x) & ~in_gh(x) & ~x.contains("@")).alias("other"))


# Degree levels, the highest first.
DEGREE_RANKS = {"PhD": 5, "Master's": 4, "Bachelor's": 3, "Associate": 2, "High School": 1}
# Words and phrases that name a level.
DEGREE_PHRASES = {
    "PhD": ("doctor", "doctorate"),
    "Master's": ("master", "masters", "master's", "mba", "emba", "magister", "degree : ms"),
    "Bachelor's": ("bachelor", "bachelors", "bachelor's", "undergraduate", "bscs", "bsit", "bsse", "bsme", "bsee", "bce", "degree : bs", "degree : be"),
    "Associate": ("associate degree", "associate's degree", "associate of science", "associate of arts", "associate of applied science", "associate of business", "associate in", "as degree"),
    "High School": ("high school", "secondary school", "higher secondary", "intermediate", "hssc", "ssc", "matric", "matriculation", "fsc", "fa", "f.sc", "f.a"),
}
# Abbreviations by their groups of letters, written together, with dots or with blanks.
DEGREE_LETTERS = {"PhD": ("ph d", "d phil"), "Master's": ("m sc", "m tech", "m eng", "m phil", "m b a", "m ba"), "Bachelor's": ("b sc", "b tech", "b eng", "b com", "b ba", "b ca"), "High School": ("a - level", "a - levels", "o - level", "o - levels")}
# Abbreviations that are words without their dots.
DEGREE_DOTTED = {"Master's": ("m.s.",), "Bachelor's": ("b.s.", "b.e."), "Associate": ("a.s.", "a.a.")}
# Short forms that count before these words and signs; not before these products.
DEGREE_SHORT = {"Master's": ("ms", "m.s"), "Bachelor's": ("bs", "be", "b.s", "b.e")}
DEGREE_FOLLOWERS = ("in", "of", "degree", "(", "-", "/")
DEGREE_FIELDS = ("computer", "software", "information", "data", "electrical", "mechanical", "civil", "electronic", "applied", "telecom", "business", "finance", "accounting", "economics", "commerce", "management")
MS_PRODUCTS = (
    "project", "office", "excel", "word", "powerpoint", "sql", "access", "azure", "teams", "visio", "dynamics", "365", "windows", "visual studio", "dos", "paint", "fabric", "copilot", "forms", "exchange",
    "sharepoint", "intune", "defender", "planner", "onenote", "onedrive", "graph",
)
#: What a line is cut into for the tables above: words with their dots and apostrophes, numbers, and signs.
_DEGREE_TOKEN = r"[a-z]+(?:['.][a-z]+)*\.?|[0-9]+|[-/(),:]"


def _degree_text(line: Column) -> Column:
    """Words and signs in lower case between blanks, hyphens and dashes alike. A full stop stays only where the word has another one."""
    tokens = F.regexp_extract_all(F.lower(F.translate(line, "’–—", "'--")), F.lit(f"({_DEGREE_TOKEN})"), 1)
    return spaced(F.transform(tokens, lambda t: F.when(F.regexp_count(t, F.lit("[.]")) > 1, t).otherwise(F.rtrim(t, F.lit(".")))))


def _degree_phrases(level: str) -> list[str]:
    """All ways in which the tables write a level, except short forms."""
    letters = [g.split(" ") for g in DEGREE_LETTERS.get(level, ())]
    spelled = [w for g in letters for w in ({"".join(g), ".".join(g), ".".join(g) + ".", " ".join(g)} if "-" not in g else {" ".join(g)})]
    return [*DEGREE_PHRASES[level], *sorted(spelled), *DEGREE_DOTTED.get(level, ())]


def _short_degree(text: Column, level: str) -> Column:
    """Short forms before a word or sign that makes them a degree, or before a field of study."""
    found = F.lit(False)
    for form in DEGREE_SHORT.get(level, ()):
        after = DEGREE_FOLLOWERS if level == "Master's" else (*DEGREE_FOLLOWERS, ",", *DEGREE_FIELDS)
        rest = F.replace(text, F.lit(f" {form} in "), F.lit(f" {form} "))
        product = holds(rest, [f"{form} {p}" for p in MS_PRODUCTS]) if form == "ms" else F.lit(False)
        found = found | (holds(text, [f"{form} {w}" for w in after]) & ~product)
    return found


def degree_of(line: Column) -> Column:
    """The first level in the list that a line names, else null."""

    def level_in(text: Column) -> Column:
        both = holds(text, ("bs / ms", "b.s. / m.s.", "b.s / m.s"))
        return first_that([(holds(text, _degree_phrases(level)) | _short_degree(text, level) | (both if level == "Master's" else F.lit(False)), F.lit(level)) for level in DEGREE_RANKS])

    return bound(_degree_text(line), level_in)


def degree_rank(degree: Column) -> Column:
    """5 (PhD) to 1 (High School), by the degree's name or an abbreviation in it; 0 where none."""
    ranked = bound(degree_of(degree), lambda level: first_that([(level == name, F.lit(rank)) for name, rank in DEGREE_RANKS.items()]))
    return F.coalesce(ranked, F.when(F.lower(degree).startswith("associate"), 2), F.lit(0))


def required_degree_rank(text: Column) -> Column:
    """The smallest level that the lines of a job text name: what a candidate must at least have; 0 where none is named."""
    ranks = F.transform(F.split(text, r"\r\n|\r|\n"), degree_rank)
    return F.coalesce(F.array_min(F.filter(ranks, lambda r: r > 0)), F.lit(0))


# Fields after "of" that only repeat the degree's name.
GENERIC_FIELDS = ("science", "arts", "engineering", "technology", "business", "commerce")
# Words that open a line of skills.
SKILL_HEADS = ("skill", "skills", "technical skills", "core skills", "key skills", "tools", "tool", "frameworks", "framework", "languages", "language", "libraries", "library", "project management", "web development", "data analytics", "data engineering", "other", "soft skills")


def _field_after(word: str) -> Column:
    """Capitalised words after a word, up to a sign or to 'from' or 'at'."""
    tail = F.regexp_extract("line", rf"\b{word}\s+([A-Z][A-Za-z& ]*)", 1)
    return F.nullif(F.trim(F.split(tail, r"\b(?:from|at)\b")[0]), F.lit(""))


def education_of(lines: DataFrame, key: str) -> DataFrame:
    """``key, degree, field, raw, rank``: one entry per level of a text, at the first line that names it."""
    head = F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1)))
    d = lines.where(~head.isin(*SKILL_HEADS)).withColumn("degree", degree_of(F.col("line"))).where("degree is not null")
    of = _field_after("of")
    f = F.coalesce(_field_after("in"), F.when(~F.lower(of).isin(*GENERIC_FIELDS), of))
    first = d.withColumn("field", F.trim(f)).groupBy(key, "degree").agg(F.min(F.struct("line_no", "line", "field")).alias("m"))
    return first.select(key, "degree", F.col("m.field").alias("field"), F.col("m.line").alias("raw"), degree_rank(F.col("degree")).alias("rank"))


# Words of the ways to state years of experience.
YEAR_UNITS = ("year", "years", "yr", "yrs")
YEAR_LEADS = ("minimum", "min", "over", "nearly", "more than", "at least")
YEAR_TAILS = ("required", "needed", "in")


def experience_years(text: Column) -> Column:
    """The largest number of years a text states; of a range its lower end; null where none.

    A number of up to two digits counts before a unit where the other end of a range, a word that leads to it, 'experience' within
    six words after it or a word that asks for it says so, and after 'experience', 'experience:' or 'experience of' by itself.
    """
    t = F.regexp_extract_all(F.lower(F.regexp_replace(F.translate(text, "–", "-"), r"[*_#`~]", " ")), F.lit(r"([a-z]+|[0-9]+|[^a-z0-9\s])"), 1)
    t = F.filter(t, lambda x: x != "+")

    def stated(tokens: Column) -> Column:
        at = lambda i, k: F.coalesce(F.try_element_at(tokens, i + k), F.lit("")) if k >= 0 else F.coalesce(F.get(tokens, i + (k - 1)), F.lit(""))
        number = lambda x: x.rlike("^[0-9]{1,2}$")

        def counts(i: Column) -> Column:
            unit = at(i, 1).isin(*YEAR_UNITS)
            ranged = at(i, 1).isin("-", "to") & number(at(i, 2)) & at(i, 3).isin(*YEAR_UNITS)
            led = at(i, -1).isin(*[w for w in YEAR_LEADS if " " not in w]) | F.concat_ws(" ", at(i, -2), at(i, -1)).isin(*YEAR_LEADS) | ((at(i, -1) == ".") & (at(i, -2) == "min"))
            upper = at(i, -1) == "-"
            tail = F.slice(tokens, i + 2, F.lit(7))
            stop = F.array_position(F.transform(tail, lambda x: x.rlike("^[a-z&/-]+$")), F.lit(False))
            said = F.array_contains(F.when(stop > 0, F.slice(tail, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(tail), "experience")
            sign = at(i, -1).isin(":", "-", "of")
            before = (at(i, -1) == "experience") | (sign & (at(i, -2) == "experience")) | ((at(i, -1) == "of") & at(i, -2).isin(":", "-") & (at(i, -3) == "experience"))
            return number(at(i, 0)) & (ranged | (unit & (led | (~upper & (said | at(i, 2).isin(*YEAR_TAILS))))) | before)

        return F.filter(F.sequence(F.lit(1), F.size(tokens)), counts)

    # The tokens are bound once, as the only element of an array.
    hits = F.flatten(F.transform(F.array(t), lambda x: F.when(F.size(x) > 0, F.transform(stated(x), lambda i: F.element_at(x, i).cast("int")))))
    return F.array_max(hits)


# Words that make an entry freelance work or an internship.
FREELANCE = ("freelance", "freelancer", "freelancing", "self-employed", "self employed", "independent contractor", "contractor", "fiverr", "upwork", "toptal", "consultant (self)", "self consultant", "independent consultant", "client project", "client work")
INTERNSHIP = ("intern", "internship", "trainee", "graduate trainee", "apprentice")


def bucket_of(context: Column, strict: bool = False) -> Column:
    """``struct<bucket, is_internship>``. Internships are found by substring, as in 'internal'; ``strict`` asks for whole words."""
    low = F.lower(F.coalesce(context, F.lit("")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    intern = low.rlike(r"\b(?:intern|internship|trainee|apprentice)\b") if strict else any_of(INTERNSHIP)
    return F.struct(F.when(any_of(FREELANCE), "freelance").otherwise("professional").alias("bucket"), intern.alias("is_internship"))


def merged_months(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``*keys, months``: months covered by the union of closed month intervals; touching ones merge."""
    w = Window.partitionBy(*keys).orderBy("s")
    thin = intervals.where(F.col(end) >= F.col(start)).groupBy(*keys, F.col(start).alias("s")).agg(F.max(end).alias("e"))
    seen = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # Of each interval only what lies beyond all earlier ends is new.
    new = F.greatest(F.col("e") - F.greatest(F.col("s") - 1, F.coalesce(F.col("seen"), F.col("s") - 1)), F.lit(0))
    return thin.withColumn("seen", seen).groupBy(*keys).agg(F.sum(new).cast("int").alias("months"))


def recency_weight(year: Column, today_year: int, half_life: float = 3.0, floor: float = 0.05, undated: float = 0.5) -> Column:
    """``0.5 ** (age / half_life)``, not below the floor; undated 0.5."""
    age = F.greatest(F.lit(today_year) - year, F.lit(0))
    # greatest and least skip nulls, so that an undated year needs its own branch.
    return F.when(year.isNull(), F.lit(undated)).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(floor), F.pow(F.lit(0.5), age / half_life))), 4))


def years_in(line: Column, today_year: int) -> Column:
    """The latest year a line is dated to: of a range its end, still running is this year; null where undated."""
    running = line.rlike(r"(?i)(?:\d{4}|\bsince\b.*)\s*(?:[-–—]|to|until)?\s*\b(?:present|current|now|ongoing|to date)\b|\bsince\s+(?:[A-Za-z]+\s+|\d{1,2}/)?[12]\d{3}\b")
    years = F.transform(F.regexp_extract_all(line, F.lit(r"\b((?:19|20)\d{2})\b"), 1), lambda x: x.cast("int"))
    return F.when(running, F.lit(today_year)).otherwise(F.array_max(F.filter(years, lambda y: y <= today_year + 2)))


def dated_entries(lines: DataFrame, key: str, today_year: int) -> DataFrame:
    """``lines`` with ``entry`` (number of the dated heading line so far) and ``last_year`` of that heading.

    A heading is a line with a range or 'since' and a year that isn't a list item; lines of education aren't dated.
    """
    head = F.col("line").rlike(r"(?i)(?:[12]\d{3}\s*(?:[-–—]|to|until)\s*\S|\bsince\b.*[12]\d{3})") & ~F.col("line").rlike(r"^[-*•]") & (F.col("section") != "education")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    year = F.when(head, years_in(F.col("line"), today_year))
    return lines.withColumn("entry", F.sum(F.when(head, 1).otherwise(0)).over(w)).withColumn("last_year", F.when(F.col("section") != "education", F.last(year, ignorenulls=True).over(w)))


def last_used(mentions: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``key, skill, last_year``: the latest year of the entries that mention a skill; null where none is dated."""
    j = mentions.select(key, "line_no", F.col("canonical").alias("skill")).join(entries.select(key, "line_no", "last_year"), [key, "line_no"], "left")
    return j.groupBy(key, "skill").agg(F.max("last_year").alias("last_year"))


# Signs and words that belong to an amount, and words that make a number a duration.
CURRENCY, AMOUNTS = "$€£", ("million", "billion", "thousand", "percent")
DURATIONS = ("year", "years", "yr", "yrs", "month", "months", "mo", "mos", "week", "weeks")
# Verbs of work done, in their base forms.
STRONG_VERBS = tuple("""build develop design deploy implement optimize optimise reduce migrate automate lead scale integrate architect create engineer launch deliver improve refactor manage configure maintain ship establish
spearhead orchestrate increase accelerate streamline containerize containerise write train analyze analyse redesign rewrite provision administer monitor secure debug test release publish mentor drive cut boost lower enhance extend
modernize upgrade consolidate execute own found construct program clean extract visualize visualise transform query process""".split())
# Irregular past forms.
IRREGULAR = {"built": "build", "led": "lead", "wrote": "write", "written": "write", "drove": "drive", "driven": "drive", "rewrote": "rewrite", "rewritten": "rewrite"}


def verb_of(word: Column) -> Column:
    """The verb of work whose form a lower-case word is, else null: endings are taken off, a doubled letter or a dropped 'e' or 'y' is put right."""
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    return F.coalesce(F.try_element_at(irregular, word), bound(_stems(word), lambda stems: _known_verb(word, stems)))


def _stems(word: Column) -> Column:
    stems = F.array(*[F.when(word.endswith(e), F.substr(word, F.lit(1), F.length(word) - len(e))) for e in ("s", "es", "d", "ed", "ing")])
    return F.array_compact(stems)


def _known_verb(word: Column, stems: Column) -> Column:
    twice = F.transform(F.filter(stems, lambda x: (F.length(x) > 2) & (F.right(x, F.lit(1)) == F.substr(x, F.length(x) - 1, F.lit(1)))), lambda x: F.substr(x, F.lit(1), F.length(x) - 1))
    soft = F.transform(F.filter(stems, lambda x: x.endswith("i")), lambda x: F.concat(F.substr(x, F.lit(1), F.length(x) - 1), F.lit("y")))
    known = F.filter(F.concat(F.array(word), stems, F.transform(stems, lambda x: F.concat(x, F.lit("e"))), twice, soft), lambda x: x.isin(*STRONG_VERBS))
    return F.try_element_at(known, F.lit(1))


def first_words(text: Column) -> Column:
    return F.slice(F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z ]", " ")), " +"), lambda w: w != ""), 1, 2)


def leading_verb(text: Column) -> Column:
    """The verb of work that a line begins with, also after an adverb; else null."""

    def leading(w: Column) -> Column:
        first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
        return F.coalesce(verb_of(F.coalesce(first, F.lit(""))), F.when(first.endswith("ly"), verb_of(F.coalesce(second, F.lit("")))))

    return bound(first_words(text), leading)


def metrics_in(text: Column) -> Column:
    """The measures of a text as written: numbers with a currency, percent or factor sign, a suffix or a word of amount, and bare ones; neither
    years nor durations."""
    t = F.transform(F.split(text, r"\s+"), lambda x: F.regexp_replace(x, r"^[(\[\"']+|[)\],.;:!?\"']+$", ""))

    def measured(tokens: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = F.lower(F.coalesce(F.get(tokens, i + 1), F.lit("")))
            body = F.regexp_replace(x, rf"^[{CURRENCY}]", "")
            plain = body.rlike(r"^[0-9][0-9,]*([.][0-9]+)?$")
            suffixed = body.rlike(r"^[0-9][0-9,]*([.][0-9]+)?([kKmMbBxX%]|[kKmMbB]?[+])$")
            year = x.rlike("^(19|20)[0-9]{2}$")
            return F.when((plain | suffixed) & ~year & ~after.isin(*DURATIONS), F.when(plain & after.isin(*AMOUNTS, "%"), F.concat_ws(" ", x, after)).otherwise(x))

        return F.array_compact(F.transform(tokens, one))

    return F.flatten(F.transform(F.array(t), measured))


def evidence_level(line: Column, in_skill_list: Column) -> Column:
    """``high_depth`` for a verb of work and a measure, ``demonstrated`` for one of them, else ``listed``; lists are ``listed``."""
    verb, metric = leading_verb(line).isNotNull(), F.size(metrics_in(line)) > 0
    return F.when(in_skill_list, "listed").when(verb & metric, "high_depth").when(verb | metric, "demonstrated").otherwise("listed")


EVIDENCE_RANK = {"listed": 0, "demonstrated": 1, "high_depth": 2}
# What a level of evidence counts.
EVIDENCE_MULTIPLIER = {"high_depth": 1.0, "demonstrated": 0.85, "listed": 0.5}


def strongest_evidence(mentions: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """``key, skill, level, multiplier, line_no``: the strongest mention of each skill; of equals the first."""
    listy = (F.size(F.split("line", r"[,;|]")) >= 4) | F.col("line").rlike(r"(?i)^\W*(?:technical\s+|key\s+|core\s+)?skills?\b")
    j = mentions.select(key, "line_no", F.col("canonical").alias("skill")).join(lines.select(key, "line_no", "line"), [key, "line_no"])
    rank = F.create_map(*[F.lit(x) for kv in EVIDENCE_RANK.items() for x in kv])
    level = j.withColumn("level", evidence_level(F.col("line"), listy)).groupBy(key, "skill").agg(F.max(F.struct(rank[F.col("level")].alias("r"), (-F.col("line_no")).alias("o"), "level")).alias("m"))
    m = F.create_map(*[F.lit(x) for kv in EVIDENCE_MULTIPLIER.items() for x in kv])
    return level.select(key, "skill", F.col("m.level").alias("level"), m[F.col("m.level")].alias("multiplier"), (-F.col("m.o")).alias("line_no"))


# The placeholders of each type, in the order in which types are replaced.
PLACEHOLDERS = (("email", EMAIL, "[EMAIL]"), ("phone", PHONE, "$1[PHONE]"), ("link", URL, "$1[LINK]"))
# Gendered pronouns and their neutral forms, and verbs that change after 'they'.
PRONOUNS = {"he": "they", "she": "they", "him": "them", "his": "their", "hers": "theirs", "himself": "themselves", "herself": "themselves"}
AGREEMENT = {"is": "are", "was": "were", "has": "have", "does": "do", "isn't": "aren't", "wasn't": "weren't", "hasn't": "haven't", "doesn't": "don't"}
# Words after 'she' and 'he' that end in s without being verbs of the third person.
NO_VERBS = ("always", "perhaps", "besides", "thus", "sometimes", "afterwards", "also", "was", "is", "has", "does")
#: Words between a pronoun and its verb that change nothing.
_ADVERB = r"(?:also|then|now|often|always|never|currently|successfully|[A-Za-z]+ly)"


def _agreeing(text: Column) -> Column:
    """'they' with verbs that agree: forms of be, have and do by the table, other verbs in the present without their s."""
    for a, b in AGREEMENT.items():
        text = F.regexp_replace(text, rf"\b([Tt]hey|THEY)((?: {_ADVERB})*) {a}\b", f"$1$2 {b}")
    mark = chr(1)
    kept = "|".join(NO_VERBS)
    subject = rf"\b([Tt]hey)((?: {_ADVERB})*) (?!(?:{kept}|[A-Za-z]*ss)\b)"
    text = F.regexp_replace(text, rf"{subject}([A-Za-z]+[^aeiou\W])ies\b", f"$1$2 $3y{mark}")
    text = F.regexp_replace(text, rf"{subject}([A-Za-z]+(?:sh|ch|x|ss|zz|o))es\b", f"$1$2 $3{mark}")
    text = F.regexp_replace(text, rf"{subject}([A-Za-z]+[^s\W{mark}])s\b(?!{mark})", "$1$2 $3")
    return F.replace(text, F.lit(mark), F.lit(""))


def redact(text: Column, types: tuple[str, ...] = ("email", "phone", "link", "year", "pronoun")) -> Column:
    """The text with placeholders. Years are replaced in lines that name a degree. Doing it twice changes nothing."""
    t = text
    for name, pattern, mark in PLACEHOLDERS:
        if name in types:
            t = F.regexp_replace(t, pattern, mark)
    if "year" in types:
        t = F.array_join(F.transform(F.split(t, "\n"), lambda x: F.when(degree_of(x).isNotNull(), F.regexp_replace(x, r"\b(?:19|20)\d{2}\b", "[YEAR]")).otherwise(x)), "\n")
    if "pronoun" in types:
        subjects = rf"\b(?:[Hh]e|[Ss]he|HE|SHE)\b"
        # Only sentences with a pronoun that is replaced are bent; 'they' of others stays as it is.
        told = t.rlike(subjects)
        for a, b in PRONOUNS.items():
            for one, other in ((a, b), (a.capitalize(), b.capitalize()), (a.upper(), b.upper())):
                t = F.regexp_replace(t, rf"\b{one}\b", other)
        for one, ours, theirs in (("her", "their", "them"), ("Her", "Their", "Them")):
            t = F.regexp_replace(F.regexp_replace(t, rf"\b{one}\b(?=\s+\w)", ours), rf"\b{one}\b", theirs)
        t = F.when(told, _agreeing(t)).otherwise(t)
    return t


def redaction_audit(lines: DataFrame, key: str) -> DataFrame:
    """``key, line_no, type, n``: what ``redact`` replaces in each line; a later type doesn't see what an earlier one took."""
    rest, parts = F.col("line"), []
    for name, pattern, mark in PLACEHOLDERS:
        parts.append(F.struct(F.lit(name).alias("type"), F.regexp_count(rest, F.lit(pattern)).alias("n")))
        rest = F.regexp_replace(rest, pattern, mark)
    parts.append(F.struct(F.lit("year").alias("type"), F.when(degree_of(F.col("line")).isNotNull(), F.regexp_count(rest, F.lit(r"\b(?:19|20)\d{2}\b"))).otherwise(0).alias("n")))
    return lines.select(key, "line_no", F.inline(F.array(*parts))).where("n > 0")


def residual_flags(lines: DataFrame, key: str) -> DataFrame:
    """``key, line_no, type, match``: personal data that is still in a redacted text."""
    hit = lambda name, pattern, cond=F.lit(True), at=1: F.when(cond & F.col("line").rlike(pattern), F.struct(F.lit(name).alias("type"), F.regexp_extract("line", f"({pattern})", at).alias("match")))
    flags = F.array_compact(F.array(
        hit("email", EMAIL), hit("phone", PHONE, at=3), hit("url", r"https?://\S+|www\.\S+"),
        hit("year", r"\b(?:19|20)\d{2}\b", degree_of(F.col("line")).isNotNull()), hit("pronoun", r"\b(?:[Hh]e|[Ss]he|[Hh]is|[Hh]er|[Hh]im)\b"),
        hit("name", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", F.col("line_no") <= 5),
    ))
    return lines.select(key, "line_no", F.inline(flags))


def candidate_ref(text: Column) -> Column:
    return F.concat(F.lit("C-"), F.left(F.sha2(text, 256), F.lit(8)))
