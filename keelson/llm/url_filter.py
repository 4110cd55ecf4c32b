"""URL filters by a temporal list join; DataFrame operations only.

A list is dated: entries (host, day, action) that add or remove a host, a parent domain standing for all hosts below it.
Entries become validity intervals [valid_from, valid_to): an addition is valid until the next entry of the same host. The
as-of join then evaluates every capture against the entries that were active on the day it was fetched; of several, the
longest host decides.

A host with a third of all captures is no hot key: captures are first reduced to their distinct (host, day) pairs, of
which a host has one for each day at most; these meet the intervals by domain and month, and only the verdicts are joined
back to the captures.

Hosts are read as browsers read them (the URL standard): control characters and blanks around a URL, and tabs and line
breaks in it, are dropped; after `http:`, `https:`, `ws:`, `wss:` and `ftp:` any number of slashes follows, none included,
and a backslash is a slash; `file:` needs two, other schemes two forward ones, and `//` stands for the scheme of the page.
User and password end at the last `@`; an IPv6 address stands in brackets. What is left is percent-decoded, full-width
characters become plain ones and ideographic full stops dots, invisible characters go, letters become small, final dots go.
A host whose last label is a number is an IPv4 address in any of its spellings and becomes dotted decimal. A host with a
character that none may have, or a number that is no address, is no host. Ports aren't judged. Not done: Punycode (a
Unicode host and its `xn--` form stay two), other compatibility characters, short forms of IPv6. Addresses have no parent
domains.

Defined results: a null URL or one without a host is never blocked; a null fetch day matches no interval; entries with a
null host or day are ignored; of entries of one host and day the removal wins; equal captures get equal verdicts; other
columns never matter; an empty list blocks nothing; no captures give no rows. URLs of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

FOREVER = "9999-12-31"


# Fixed values of the URL standard: schemes whose URLs have a host at once, characters that no host has, invisible ones.
SPECIAL = "https?|wss?|ftp"
FORBIDDEN = r"[\x00-\x20\x7f#/:<>?@\[\\\]^|%]"
INVISIBLE = "\u00ad\u034f\u180b\u180c\u180d\u200b\u2060\u2064\ufeff" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Full-width forms and the plain characters they stand for, and two more full stops.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3002\uff61"
PLAIN = "".join(map(chr, range(0x21, 0x7F))) + ".."


def number(label: Column) -> Column:
    """The value of a label of an IPv4 address: hexadecimal, octal or decimal; null if it is none or far too large."""
    digits = (
        F.when(label.rlike(r"^0x[0-9a-f]*\z"), F.conv(F.concat(F.lit("0"), F.substr(label, F.lit(3))), 16, 10))
        .when(label.rlike(r"^0[0-7]*\z"), F.conv(label, 8, 10))
        .when(label.rlike(r"^[1-9][0-9]*\z"), label)
    )
    return digits.try_cast("long")


def dotted(host: Column) -> Column:
    """An IPv4 address in its usual form, or null if the labels give none."""
    values = F.transform(F.split(host, r"\."), number)

    def joined(n: Column) -> Column:
        last = F.element_at(n, -1)
        head = F.slice(n, F.lit(1), F.size(n) - 1)
        fits = (F.size(n) <= 4) & F.forall(head, lambda x: x.between(0, 255)) & (last >= 0) & (last < F.pow(F.lit(256), 5 - F.size(n)))
        byte = lambda i: F.when(i < F.size(n) - 1, F.get(n, i)).otherwise(F.pmod(F.floor(last / F.pow(F.lit(256), 3 - i)), F.lit(256)))
        return F.when(fits, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: byte(i).cast("string")), "."))

    return F.get(F.transform(F.array(values), joined), F.lit(0))


def host_of(url: Column) -> Column:
    """The host, as the module's docstring says; null if there is none."""
    bare = F.translate(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), "\t\n\r", "")
    special = rf"^(?i:(?:{SPECIAL}):[/\\]*|(?:file:)?[/\\]{{2}})([^/\\?#]*)"
    other = rf"^(?!(?i:{SPECIAL}|file):)[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
    authority = F.concat(F.regexp_extract(bare, special, 1), F.regexp_extract(bare, other, 1))
    place = F.regexp_extract(F.regexp_replace(authority, r"(?s)^.*@", ""), r"^(\[[^\]]*\]|[^:\[]*)(?::|\z)", 1)
    # `+` is no blank here, and a `%` without two digits stays
    decoded = F.try_url_decode(F.regexp_replace(F.regexp_replace(place, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))
    plain = F.translate(F.translate(decoded, WIDE, PLAIN), INVISIBLE, "")
    name = F.regexp_replace(F.lower(plain), r"\.+\z", "")
    judged = F.get(F.transform(F.array(name), lambda h: F.when(h.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\z"), dotted(h)).when((h != "") & ~h.rlike(FORBIDDEN), h)), F.lit(0))
    return F.when(place.startswith("["), F.lower(place)).otherwise(judged)


def intervals(entries: DataFrame) -> DataFrame:
    """entries: host, day, action (add or remove), reason. Rows: host, reason, valid_from, valid_to (exclusive)."""
    clean = entries.filter("host IS NOT NULL AND day IS NOT NULL").groupBy(F.lower("host").alias("host"), "day").agg(
        F.max("action").alias("action"), F.min("reason").alias("reason")
    )
    following = F.lead("day").over(W.partitionBy("host").orderBy("day"))
    dated = clean.withColumn("valid_to", F.coalesce(following, F.lit(FOREVER).cast("date")))
    return dated.filter("action = 'add'").select("host", "reason", F.col("day").alias("valid_from"), "valid_to")


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first."""
    parts = F.split(host, r"\.")
    count = F.when(host.rlike(r"^([0-9.]+|\[.*)$"), 1).otherwise(F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: page_id, url, fetch_day. Per row: page_id, host, fetch_day, blocked, entry, reason, valid_from, valid_to."""
    home = common.shared_dir(captures.sparkSession)
    seen = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetch_day")
    asked = common.keep(seen.filter("host IS NOT NULL AND fetch_day IS NOT NULL").select("host", "fetch_day").distinct(), f"{home}/asked")
    # an open interval lasts, for the join, to the last day asked for
    first, last = asked.agg(F.min("fetch_day"), F.max("fetch_day")).head()
    first_day, last_day = F.lit(first).cast("date"), F.lit(last).cast("date")
    month = lambda d: F.date_trunc("month", d).cast("date")
    cut = intervals(entries).filter((F.col("valid_from") <= last_day) & (F.col("valid_to") > first_day) & (F.col("valid_from") < F.col("valid_to")))
    cut = cut.withColumn("month", F.explode(F.sequence(month(F.greatest("valid_from", first_day)), month(F.least("valid_to", last_day)), F.expr("INTERVAL 1 MONTH"))))
    cut = cut.select(F.col("host").alias("entry"), "reason", "valid_from", "valid_to", "month")
    tried = asked.select("host", "fetch_day", month(F.col("fetch_day")).alias("month"), F.explode(suffixes(F.col("host"))).alias("entry"))
    hits = tried.join(cut, ["entry", "month"]).filter("valid_from <= fetch_day AND fetch_day < valid_to")
    best = hits.groupBy("host", "fetch_day").agg(F.max(F.struct(F.length("entry").alias("size"), "entry", "reason", "valid_from", "valid_to")).alias("hit"))
    # a table of its own, so that the join is between two plain exchanges and Spark can split a host's day
    best = common.keep(best, f"{home}/best")
    out = seen.join(best, ["host", "fetch_day"], "left")
    return out.select("page_id", "host", "fetch_day", F.col("hit").isNotNull().alias("blocked"), *[F.col(f"hit.{c}").alias(c) for c in ("entry", "reason", "valid_from", "valid_to")])
