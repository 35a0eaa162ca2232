"""Parsing, calendar, text and label functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_even

#: Tokens that stand for a missing number.
MISSING = ("", ".", "NA", "NaN", "nan")
#: Query parameters that hold secrets.
SECRETS = ("api_key", "apikey", "key", "token")
#: Words for frequency codes.
FREQUENCIES = {"D": "Daily", "M": "Monthly", "Q": "Quarterly", "A": "Annual"}
#: Party ids and names and their labels.
PARTIES_BY_ID = {"Q29552": "D", "Q29468": "R"}
PARTIES_BY_NAME = {"democratic": "D", "democrat": "D", "democratic party": "D", "republican": "R", "republican party": "R"}


def parse_date(s: Column) -> Column:
    """The date in the first ten characters; null if there is none. Times are cut off, never converted."""
    return F.try_to_timestamp(F.substring(F.trim(s), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def parse_number(s: Column, missing: tuple[str, ...] = MISSING) -> Column:
    """A number, or null for missing tokens and for what isn't a number."""
    t = F.trim(s)
    return F.when(~t.isin(*missing), t.try_cast("double"))


def parse_loose(s: Column) -> Column:
    """As readers of finished tables parse: only blanks are missing; NaN and infinities stay."""
    return parse_number(s, ("",))


def month_start(d: Column) -> Column:
    return F.trunc(d, "month").cast("date")


def add_months(d: Column, n: int | Column) -> Column:
    """The first of the month ``n`` months after that of ``d``."""
    return F.add_months(month_start(d), n)


def period(d: Column, freq: Column | str, kind: Column | str | None = None, fy_month: Column | int = 10, fy_day: Column | int = 1) -> Column:
    """The half-open period ``(start, end)`` that a date stands for: its month, quarter, year or fiscal year.

    A fiscal year is named by the year in which it ends. Unknown frequencies give null.
    """
    freq = F.lit(freq) if isinstance(freq, str) else freq
    kind = F.lit(kind) if isinstance(kind, (str, type(None))) else kind
    fy_month, fy_day = (F.lit(x) if isinstance(x, int) else x for x in (fy_month, fy_day))
    quarter, y = F.trunc(d, "quarter"), F.year(d)
    make = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    fiscal = make(F.make_date(y - 1, fy_month, fy_day), F.make_date(y, fy_month, fy_day))
    year = make(F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y + 1, F.lit(1), F.lit(1)))
    return (
        F.when(freq == "M", make(month_start(d), add_months(d, 1)))
        .when(freq == "Q", make(quarter, F.add_months(quarter, 3)))
        .when((freq == "A") & kind.eqNullSafe("us_fiscal_year"), fiscal)
        .when(freq == "A", year)
    )


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.date_diff(F.least(a_end, b_end), F.greatest(a_start, b_start)))


def round6(v: Column) -> Column:
    """The six decimals that pass between stages: half to even, by the exact binary value."""
    return round_even(v, 6)


def clean_label(s: Column) -> Column:
    """A label up to its first bracket, unless it starts with one."""
    return F.when(F.instr(s, "(") > 1, F.trim(F.substring_index(s, "(", 1))).otherwise(s)


def md_escape(s: Column) -> Column:
    return F.replace(s, F.lit("|"), F.lit("\\|"))


def interval_text(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("["), low.cast("string"), F.lit(", "), high.cast("string"), F.lit("]"))).otherwise("")


def last_segment(uri: Column) -> Column:
    return F.element_at(F.split(F.rtrim(uri, F.lit("/")), "/"), -1)


def party_label(party_id: Column, name: Column) -> Column:
    """D, R or Other, by id or else by name."""
    by_id = F.try_element_at(F.create_map(*[F.lit(x) for kv in PARTIES_BY_ID.items() for x in kv]), F.coalesce(party_id, F.lit("")))
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for kv in PARTIES_BY_NAME.items() for x in kv]), F.lower(F.trim(F.coalesce(name, F.lit("")))))
    return F.coalesce(by_id, by_name, F.lit("Other"))


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, f"(?i)([?&](?:{'|'.join(SECRETS)})=)[^&#]*", "$1REDACTED")


def content_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def frequency_label(code: Column) -> Column:
    """The word for a frequency code; other codes pass through."""
    named = F.create_map(*[F.lit(x) for kv in FREQUENCIES.items() for x in kv])
    return F.coalesce(F.try_element_at(named, code), code)


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def normalize_text(s: Column) -> Column:
    """Line breaks unified, blanks collapsed and trimmed in each line, runs of empty lines made one, ends trimmed."""
    lines = F.transform(F.split(F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[ \t\u000b\f]+", " ")))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), F.lit("\n "))


def strip_html(html: Column) -> Column:
    """The text of a page: scripts, styles and comments dropped, block ends as line breaks, tags and common entities resolved."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|table|section|article)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return normalize_text(t)


#: The containers in which a page's content is looked for, and what is left out of them.
CONTAINERS = ("main", "article", "body")
BOILERPLATE = ("svg", "iframe", "form", "nav", "footer", "header", "aside")


#: A tag, a raw element (whose inside has no tags), a run of text, or a lone bracket.
_TOKEN = r"""(?is)<(script|style|noscript)\b.*?</\1\s*>|<(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>|[^<]+|<"""


def _tags(html: Column) -> Column:
    """A page's tokens: ``text``, and of the tags of containers and boilerplate the ``name`` and whether it is an end (``closes``)."""
    known = "|".join(CONTAINERS + BOILERPLATE)

    def token(x: Column) -> Column:
        name = F.nullif(F.lower(F.regexp_extract(x, rf"(?is)^</?({known})\b.*(?<!/)>$", 1)), F.lit(""))
        return F.struct(x.alias("text"), name.alias("name"), F.startswith(x, F.lit("</")).alias("closes"))

    return F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), token)


def _elements(tags: Column) -> Column:
    """``name, first, last``: the tokens with which each container or boilerplate element begins and ends.

    A fold over the tags with a stack of open elements. An end closes the last open element of its name, and so all
    that were opened in it and not closed; ends without a beginning are passed over. A container that is never closed
    goes on to the end of the page; boilerplate that is never closed is no element.
    """
    kind = "array<struct<name:string,first:int>>"
    done = "array<struct<name:string,first:int,last:int>>"
    state = lambda i, open_, found: F.struct(i.alias("i"), open_.alias("open"), found.alias("found"))

    def step(a: Column, t: Column) -> Column:
        top = F.array_position(F.reverse(F.transform(a["open"], lambda o: o["name"])), t["name"]).cast("int")
        at = F.size(a["open"]) - top
        ended = F.struct(t["name"].alias("name"), F.get(a["open"], at)["first"].alias("first"), a["i"].alias("last"))
        opens, closes = t["name"].isNotNull() & ~t["closes"], t["name"].isNotNull() & t["closes"] & (top > 0)
        stack = F.when(opens, F.concat(a["open"], F.array(F.struct(t["name"].alias("name"), a["i"].alias("first"))))).when(closes, F.slice(a["open"], F.lit(1), at)).otherwise(a["open"])
        return state((a["i"] + 1).cast("int"), stack.cast(kind), F.when(closes, F.concat(a["found"], F.array(ended))).otherwise(a["found"]).cast(done))

    def finish(a: Column) -> Column:
        rest = F.filter(a["open"], lambda o: o["name"].isin(*CONTAINERS))
        return F.concat(a["found"], F.transform(rest, lambda o: F.struct(o["name"].alias("name"), o["first"].alias("first"), a["i"].alias("last"))))

    return F.aggregate(tags, state(F.lit(0), F.array().cast(kind), F.array().cast(done)), step, finish)


def main_html(html: Column) -> Column:
    """The inside of a page's first ``main``, else ``article``, else ``body`` (else all of it), without boilerplate elements.

    Elements of one name may be nested. Containers with nothing in them are passed over; each boilerplate element
    leaves a blank, and so does a comment.
    """
    plain = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")

    def inside(page: Column) -> Column:
        tags, found = page["tags"], page["found"]
        whole = F.struct(F.lit("").alias("name"), F.lit(-1).alias("first"), F.size(tags).alias("last"))
        first = lambda c: F.array_min(F.transform(F.filter(found, lambda e: (e["name"] == c) & (e["last"] > e["first"] + 1)), lambda e: F.struct(e["first"].alias("first"), e["last"].alias("last"))))
        held = F.coalesce(*[first(c) for c in CONTAINERS], F.struct(whole["first"].alias("first"), whole["last"].alias("last")))
        return F.get(F.transform(F.array(held), lambda h: text(tags, found, h)), 0)

    def text(tags: Column, found: Column, held: Column) -> Column:
        cuts = F.filter(found, lambda e: e["name"].isin(*BOILERPLATE) & (e["first"] > held["first"]) & (e["last"] < held["last"]))

        def piece(t: Column, i: Column) -> Column:
            at = i + held["first"] + 1
            within = F.exists(cuts, lambda e: (e["first"] < at) & (at <= e["last"]))
            return F.when(within, "").when(F.exists(cuts, lambda e: e["first"] == at), " ").otherwise(t["text"])

        return F.array_join(F.transform(F.slice(tags, held["first"] + 2, held["last"] - held["first"] - 1), piece), "")

    pages = F.transform(F.array(_tags(plain)), lambda t: F.struct(t.alias("tags"), _elements(t).alias("found")))
    return F.get(F.transform(pages, inside), 0)


def first_line(s: Column, most: int = 160) -> Column:
    """The first line that isn't blank, trimmed and cut; null if there is none."""
    return F.substring(F.get(F.filter(F.transform(F.split(s, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), 1, most)
