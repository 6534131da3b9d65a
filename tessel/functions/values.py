"""Column functions on single values: codes, credits, dates, tags, ratings, pay, visibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of a course code.
CODE = r"^([A-Z]{2,4})\s?([0-9]{4}[A-Z]?)$"


def normalize_code(c: Column) -> Column:
    """'cs5800 ' to 'CS 5800'; null if it is no code."""
    u = F.upper(F.trim(c))
    return F.when(u.rlike(CODE), F.regexp_replace(u, CODE, "$1 $2"))


def record_id(code: Column, head: str = "cat") -> Column:
    """head-<dept>-<number> from a normalized code."""
    return F.concat(F.lit(f"{head}-"), F.lower(F.regexp_replace(code, " ", "-")))


def whole_credits(c: Column) -> Column:
    """A number that is whole, as int; null else."""
    x = c.try_cast("double")
    return F.when(x == F.floor(x), x.cast("int"))


def date_head(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")).try_cast("date")


def tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "--"), lambda x: F.trim(x)), lambda x: x != "")


def within(c: Column, low: float, high: float) -> Column:
    """A number between bounds, null else."""
    x = c.try_cast("double")
    return F.when(x.between(low, high), x)


def epoch_time(c: Column) -> Column:
    return F.coalesce(F.timestamp_seconds(c.try_cast("double")), F.timestamp_seconds(F.lit(0)))


def pay_bucket(c: Column) -> Column:
    """Hourly pay in steps of 10, one bucket from 100."""
    n = F.floor(c)
    low = (F.floor(n / 10) * 10).cast("string")
    high = (F.floor(n / 10) * 10 + 10).cast("string")
    return F.when(n >= 100, "$100+/hr").when(n.isNotNull(), F.concat(F.lit("$"), low, F.lit("-"), high, F.lit("/hr")))


def visibility(salary: Column, interview: Column, technical: Column) -> Column:
    """2 with pay, 1 with interview or technical notes, 0 else; '' counts as absent."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(salary), 2).when(has(interview) | has(technical), 1).otherwise(0)


def email_allowed(c: Column, domains: list[str]) -> Column:
    """One @, and a domain of the list exactly."""
    parts = F.split(c, "@")
    return (F.size(parts) == 2) & F.lower(F.trim(F.get(parts, F.lit(1)))).isin(domains)


def xml_attribute(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def looks_complete(c: Column) -> Column:
    """6 to 140 characters and no dangling function word or comma at the end."""
    # fixed values: words and marks that a complete text doesn't end with
    dangling = r"(?i)(?:(?:^|[^A-Za-z0-9_])(?:of|for|the|and|or|on|to|with|a|an|in)\s*$|(?:如何|与|和)\s*$|[,、，:：]\s*$)"
    return F.length(c).between(6, 140) & ~c.rlike(dangling)


def redact(c: Column, domains: tuple[str, ...] = ("campus.example.edu",)) -> Column:
    """First pass over personal data: addresses of the given domains, US phones, profile links, in that order."""
    # fixed values: the patterns of addresses, phones and profile links, in this order
    hosts = "|".join(d.replace(".", r"\.") for d in domains)
    c = F.regexp_replace(c, rf"\b[A-Za-z][A-Za-z0-9._%+-]*@(?:{hosts})\b", "[EMAIL]")
    c = F.regexp_replace(c, r"(?:\+?1[-. \t\n]?)?\(?[0-9]{3}\)?[-. \t\n]?[0-9]{3}[-. \t\n]?[0-9]{4}\b", "[PHONE]")
    return F.regexp_replace(c, r"https?://(?:www\.)?(?:linkedin\.com/in/|github\.com/)[A-Za-z0-9_-]+/?", "[URL]")


def industry(c: Column, groups: dict[str, list[str]], default: str = "other") -> Column:
    """The group whose list has the company, by lower case; ``default`` for unknown ones."""
    pairs = [F.lit(x) for g, names in groups.items() for n in names for x in (n.lower(), g)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(c))), F.lit(default))


def source_block(text: Column, attributes: dict[str, Column], tag: str = "source") -> Column:
    """An XML element: attributes in order of their names, nulls left out; an end tag within the text can't close it."""
    parts = [F.concat(F.lit(f' {k}="'), xml_attribute(v.cast("string")), F.lit('"')) for k, v in sorted(attributes.items())]
    safe = F.regexp_replace(text, rf"(?i)</(\s*{tag})", "<\\\\/$1")
    return F.concat(F.lit(f"<{tag}"), *[F.coalesce(p, F.lit("")) for p in parts], F.lit(">\n"), safe, F.lit(f"\n</{tag}>"))


def source_list(sources: Column, tag: str = "source") -> Column:
    """Elements of ``sources``, an array of struct(id, type, text), a blank line between; an id that is empty or comes twice is an error."""
    ids = F.transform(sources, lambda s: s["id"])
    empty = F.exists(ids, lambda i: F.coalesce(i, F.lit("")) == "")
    text = F.array_join(F.transform(sources, lambda s: source_block(s["text"], {"id": s["id"], "type": s["type"]}, tag)), "\n\n")
    return F.when(empty, F.raise_error(F.lit("a source has no id"))).when(F.size(F.array_distinct(ids)) < F.size(ids), F.raise_error(F.concat(F.lit("a source id comes twice: "), F.array_join(ids, ", ")))).otherwise(text)


def capped(c: Column, n: int, mark: str = "…") -> Column:
    """At most ``n`` characters, with a mark where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def bullets(lists: dict[str, tuple[Column, int]]) -> Column:
    """A line per list that has entries: its name and at most so many of them."""
    line = lambda name, c, n: F.when(F.size(c) > 0, F.concat(F.lit(f"- {name}: "), F.array_join(F.slice(c, 1, n), ", ")))
    return F.concat_ws("\n", *[line(k, c, n) for k, (c, n) in lists.items()])
