"""Text, number and name functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quernstone.functions import tables as t


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def quoted(text: str) -> str:
    """``text`` as a literal in a Java pattern."""
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in text)


def tokens(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def bm25_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; all other marks and blanks separate."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cache_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slug(name: Column) -> Column:
    """Lower case with runs of other characters as one underline, at most 80 characters; ``metric`` if nothing is left."""
    plain = F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(plain == "", "metric").otherwise(F.substring(plain, 1, 80))


def metric_id(ticker: Column, year: Column, name: Column) -> Column:
    return F.concat_ws("_", F.upper(ticker), year.cast("string"), slug(name))


def years(text: Column) -> Column:
    """The distinct years 2019 to 2029 of a text, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({t.YEAR})"), F.lit(1)), lambda y: y.cast("bigint"))))


def coerced_year(raw: Column, fallback: Column) -> Column:
    """The first four characters as a year from 2015 to 2030, else the fallback."""
    year = F.substring(F.trim(raw), 1, 4).try_cast("bigint")
    return F.when(year.between(2015, 2030), year).otherwise(fallback)


def mentioned(text: Column, aliases: dict[str, str], tickers: list[str]) -> Column:
    """The distinct tickers a text names by alias or symbol, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    by_alias = [F.when(low.rlike(rf"\b{quoted(a)}\b"), F.lit(s)) for a, s in aliases.items()]
    by_symbol = [F.when(low.rlike(rf"\b{quoted(s.lower())}\b"), F.lit(s)) for s in tickers]
    return F.array_sort(F.array_distinct(F.filter(F.array(*by_alias, *by_symbol), lambda x: x.isNotNull())))


def canonical_company(raw: Column, tickers: tuple[str, ...] = t.TICKERS) -> Column:
    """A company's ticker by alias, symbol, alias within its letters, or misread symbol; else the trimmed name.

    An alias counts wherever its letters stand, so "metals" is META.
    """
    aliases = F.create_map(*[F.lit(x) for kv in t.COMPANY_ALIASES.items() for x in kv])
    parts = F.array(*[F.struct(F.lit("".join(c for c in a if "a" <= c <= "z")).alias("part"), F.lit(s).alias("ticker")) for a, s in t.COMPANY_ALIASES.items()])

    def canonical(name: Column) -> Column:
        letters, capitals = F.regexp_replace(F.lower(name), "[^a-z]", ""), F.regexp_replace(F.upper(name), "[^A-Z]", "")
        inside = F.get(F.filter(parts, lambda p: letters.contains(p["part"])), F.lit(0))["ticker"]
        misread = F.when(capitals.isin(*[s for s in t.TICKERS if s != "BRK.B"]), capitals).when(capitals.isin(*t.BRK_FORMS), "BRK.B")
        return F.when(name == "", None).otherwise(F.coalesce(F.element_at(aliases, F.lower(name)), F.when(F.upper(name).isin(*tickers), F.upper(name)), inside, misread, name))

    return F.element_at(F.transform(F.array(F.trim(raw)), canonical), 1)


def noisy_company(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return (low == "") | low.isin(*t.NOISY_COMPANIES) | any_of([low.startswith(p) for p in t.NOISY_COMPANY_PREFIXES]) | (F.length(F.trim(name)) > 60)


def noise_name(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return low.isin(*t.NOISE_NAMES) | any_of([low.startswith(p) for p in t.NOISE_PREFIXES]) | low.contains("various industries") | (F.length(name) > 60)


def entity_key(name: Column, label: Column, ticker: Column, year: Column) -> Column:
    """The primary key of an entity, null if it is dropped.

    Companies are canonical and not noise; metrics carry their company and
    year; other labels drop what is really a company, and very long names.
    """
    raw = F.trim(name)

    def keyed(company: Column) -> Column:
        return (
            F.when(raw == "", None)
            .when(label == "Company", F.when(~noisy_company(company), company))
            .when((label == "FinancialMetric") & ticker.isNotNull() & year.isNotNull(), metric_id(ticker, year, raw))
            .when(F.length(raw) > 300, None)
            .when((label != "FinancialMetric") & company.isin(*t.TICKERS), None)
            .otherwise(raw)
        )

    # As a lambda's variable the long expression is evaluated, and planned, once.
    return F.element_at(F.transform(F.array(canonical_company(name)), keyed), 1)


def expanded_query(question: Column) -> Column:
    """The question and the synonyms of each metric it names."""
    extras = [F.when(F.lower(question).contains(k), F.lit(v)) for k, v in t.METRIC_SYNONYMS.items()]
    return F.concat_ws(" ", question, *extras)


def entity_candidates(question: Column) -> Column:
    """What a question may name: symbols, capitalised and lower-case phrases, the rest as one phrase, and tickers of aliases."""
    stop = F.array(*map(F.lit, t.STOPWORDS))
    find = lambda p: F.regexp_extract_all(question, F.lit(f"({p})"), F.lit(1))
    proper = F.filter(find(t.PROPER_PHRASE), lambda w: ~F.array_contains(stop, F.lower(w)))
    plain = F.filter(find(t.PLAIN_PHRASE), lambda w: ~F.array_contains(stop, w))
    names = F.create_map(*[F.lit(x) for kv in t.QUERY_ALIASES.items() for x in kv])
    alias = F.filter(F.transform(F.concat(proper, plain), lambda w: F.element_at(names, F.lower(w))), lambda x: x.isNotNull())
    left = F.regexp_replace(F.lower(F.regexp_replace(question, r"[\s'-]+", " ")), rf"\b(?:{'|'.join(t.COMPACT_WORDS)})\b", " ")
    left = F.filter(F.split(left, r"\s+"), lambda w: (w != "") & ~F.array_contains(stop, w))
    rest = F.when(F.size(left) >= 2, F.array(F.array_join(left, " "))).otherwise(F.array().cast("array<string>"))
    every = F.transform(F.concat(find(t.SYMBOL), proper, plain, alias, rest), F.trim)
    return F.array_sort(F.array_distinct(F.filter(every, lambda w: F.length(w) >= 2)))


def parsed_number(raw: Column) -> Column:
    """``$391,035``, ``12.5B`` or ``5%`` as a number; else the first number in the text, else null."""
    s = F.trim(F.regexp_replace(F.trim(raw), "[,$%]", ""))
    unit = F.lower(F.substring(F.regexp_extract(s, t.SCALED_NUMBER, 2), 1, 1))
    times = F.when(unit == "b", 1e9).when(unit == "m", 1e6).when(unit.isin("k", "t"), 1e3).otherwise(1.0)
    first = F.regexp_extract(s, t.NUMBER, 0)
    return F.when(s.rlike(t.SCALED_NUMBER), F.regexp_extract(s, t.SCALED_NUMBER, 1).try_cast("double") * times).otherwise(first.try_cast("double"))


def calculate(operation: Column, a: Column, b: Column) -> Column:
    """yoy_pct and pct_change (percent), diff, ratio, sum, avg of two numbers; null on a zero base or another name."""
    base = F.when(b != 0, b)
    return (
        F.when(operation.isin("yoy_pct", "pct_change"), (a - base) / F.abs(base) * 100)
        .when(operation == "diff", a - b)
        .when(operation == "ratio", a / base)
        .when(operation == "sum", a + b)
        .when(operation == "avg", (a + b) / 2)
    )


def market_cap(millions: Column) -> Column:
    """A market capitalisation in millions as $1.23T, $4.5B or $67M; below a million in six digits, nothing for none."""
    v = millions * 1e6
    # format_number rounds the exact binary value, where %.2f rounds its shortest decimal form.
    form = lambda unit, digits, mark: F.concat(F.lit("$"), F.replace(F.format_number(v / unit, digits), F.lit(",")), F.lit(mark))
    return F.when(v >= 1e12, form(1e12, 2, "T")).when(v >= 1e9, form(1e9, 1, "B")).when(v >= 1e6, form(1e6, 0, "M")).when(v != 0, F.concat(F.lit("$"), six_digits(v))).otherwise("")


def six_digits(v: Column) -> Column:
    """A number in six significant digits without zeros at its end, from 1e6 on and below 1e-4 with an exponent."""
    power = F.regexp_extract(F.format_string("%.5e", v), "e(.*)$", 1)
    e = power.cast("int")
    bare = lambda x, digits: F.regexp_replace(F.replace(F.format_number(x, digits), F.lit(",")), r"\.?0+$" if digits else "$^", "")
    plain = F.coalesce(*(F.when(e == k, bare(v, 5 - k)) for k in range(-4, 6)))
    return F.when(e.between(-4, 5), plain).otherwise(F.concat(bare(v / F.pow(F.lit(10.0), e), 5), F.lit("e"), power))


def without_thinking(text: Column) -> Column:
    """The text without ``<think>`` blocks and code fences."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"```(?:json)?", ""), r"\A\s+|\s+\z", "")


def skippable(text: Column, section: Column) -> Column:
    """Chunks not worth extracting from: under 20 words, or boilerplate sections without a telling word."""
    telling = any_of([F.lower(text).contains(w) for w in t.KEEP_WORDS])
    return (F.size(tokens(F.coalesce(text, F.lit("")))) < 20) | (F.coalesce(section, F.lit("")).rlike(f"(?i)({t.SKIPPABLE_SECTION})") & ~telling)


def asks_metrics(question: Column) -> Column:
    """Does a question ask about metrics: does it hold a keyword or a synonym's key?"""
    low = F.lower(F.coalesce(question, F.lit("")))
    return any_of([low.contains(w) for w in (*t.METRIC_KEYWORDS, *t.METRIC_SYNONYMS)])


def valid_ticker(ticker: Column) -> Column:
    """Letters and digits, with dots or dashes between."""
    return F.coalesce(F.regexp_replace(ticker, "[.-]", "").rlike(r"\A[A-Za-z0-9]+\z"), F.lit(False))


def ticker_key(ticker: Column) -> Column:
    """The upper-cased ticker without dots and blanks, for comparison."""
    return F.regexp_replace(F.upper(ticker), r"[.\s]", "")


def hinted(metric: Column, hint: Column) -> Column:
    """Does a metric's name hold the hint, or any word of it?"""
    low = F.lower(hint)
    return F.lower(metric).contains(low) | F.exists(tokens(low), lambda w: F.lower(metric).contains(w))


def epoch_date(seconds: Column) -> Column:
    """The day (UTC) of a Unix time as text; empty for null and 0."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").otherwise(day)


def within_days(day: Column, today: Column, days: Column) -> Column:
    """Is a day one of the last ``days`` (7 for null and 0; at least 1, at most 30) before ``today``, both ends included?"""
    wanted = F.when(F.coalesce(days, F.lit(0)) == 0, 7).otherwise(days)
    return day.between(F.date_sub(today, F.greatest(F.lit(1), F.least(wanted, F.lit(30))).cast("int")), today)


def merged(record: Column, extra: Column) -> Column:
    """A map of a record's values with another's put over it; a null map adds nothing."""
    none = F.create_map().cast("map<string,string>")
    extra = F.coalesce(extra, none)
    return F.map_concat(F.map_filter(record, lambda k, v: ~F.map_contains_key(extra, k)), extra)
