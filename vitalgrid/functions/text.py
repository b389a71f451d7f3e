"""Text Column expressions: scrubbing, redaction, formatting, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import col

# What counts as a literal, a credential-like setting, or session noise.
DOLLAR_QUOTED = r"\$[A-Za-z0-9_]*\$[\s\S]*?\$[A-Za-z0-9_]*\$"
# A literal with doubled quotes is a run of adjacent plain ones. The possessive forms match
# iteratively, so the length of a text never shows up as stack depth.
SINGLE_QUOTED = r"(?:'[^']*+')++"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
UUID = (r"(?<![A-Za-z0-9_])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}"
        r"-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![A-Za-z0-9_])")
BARE_NUMBER = r"(?<![$A-Za-z0-9_])\d+(?:\.\d+)?(?![A-Za-z0-9_])"
SECRET_SETTING = r"(?i)(password|_key$|^ssl_.*_file$)"
SESSION_NOISE = r"(?i)^\s*(set|show|reset|begin|commit|rollback|discard|deallocate|start)(?![A-Za-z0-9_])"
SELF_QUERY = "pg_stat_statements"
REDACTED = "«redacted»"

ELLIPSIS = "…"


def scrub_statement(text: Column | str) -> Column:
    """Remove literals from SQL text; numbered placeholders stay.

    Quoted regions go first because they may hold mail addresses, ids or numbers.
    """
    s = F.regexp_replace(col(text), DOLLAR_QUOTED, r"\$REDACTED\$")
    s = F.regexp_replace(s, SINGLE_QUOTED, "'?'")
    s = F.regexp_replace(s, EMAIL, "?")
    s = F.regexp_replace(s, UUID, "?")
    return F.regexp_replace(s, BARE_NUMBER, "?")


def redact_conn_string(text: Column | str) -> Column:
    """Mask the password of a URL or keyword connection string."""
    s = col(text)
    url = F.regexp_replace(s, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^:/?#@]*):[^/?#]*@", "$1:REDACTED@")
    keyword = F.regexp_replace(s, r"""(?i)(password\s*=\s*)('[^']*'|"[^"]*"|\S+)""", "$1REDACTED")
    return F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*@"), url).otherwise(keyword)


def redact_setting(name: Column | str, value: Column | str) -> Column:
    return F.when(col(value).isNotNull() & col(name).rlike(SECRET_SETTING), F.lit(REDACTED)).otherwise(col(value))


def workload_statement(text: Column | str) -> Column:
    """True for statements that are the workload, not session control or self-queries."""
    s = col(text)
    return ~s.rlike(SESSION_NOISE) & ~F.lower(s).contains(SELF_QUERY)


def plain_select(text: Column | str) -> Column:
    """Cleaned text of a single plain SELECT, NULL when it must not be planned."""
    s = F.regexp_replace(F.regexp_replace(col(text), r"^\s+", ""), r"[;\s]+$", "")
    fine = s.rlike(r"(?i)^select(?![A-Za-z0-9_])") & ~s.contains(";")
    return F.when(fine, s)


def collapse_ws(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def truncate(text: Column | str, n: int) -> Column:
    s = col(text)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit(ELLIPSIS))).otherwise(s)


def first_ten(items: Column | str) -> Column:
    a = col(items)
    return F.when(F.size(a) > 10, F.concat(F.slice(a, 1, 10), F.array(F.lit(ELLIPSIS)))).otherwise(a)


def _fixed(x: Column, places: int) -> Column:
    """Fixed-point text, ties to even, as figures are printed elsewhere."""
    return F.format_string(f"%.{places}f", F.bround(x, places))


def human_count(v: Column | str) -> Column:
    x = col(v).cast("long")
    d = x.cast("double")
    return (F.when(x >= 10**9, F.concat(_fixed(d / 1e9, 1), F.lit("G")))
            .when(x >= 10**6, F.concat(_fixed(d / 1e6, 1), F.lit("M")))
            .when(x >= 10**3, F.concat(_fixed(d / 1e3, 1), F.lit("k")))
            .otherwise(x.cast("string")))


def human_bytes(v: Column | str) -> Column:
    x = col(v).cast("long")
    d = x.cast("double")
    out = F.when(x < 1024, F.format_string("%d B", x))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), start=1):
        out = out.when(x < F.lit(1024 ** (power + 1)), F.concat(_fixed(d / float(1024**power), 1), F.lit(f" {unit}")))
    return out.otherwise(F.concat(_fixed(d / float(1024**6), 1), F.lit(" EiB")))


def short_duration(sec: Column | str) -> Column:
    s = col(sec).cast("long")
    d = s.cast("double")
    return (F.when(s >= 86400, F.concat(_fixed(d / 86400, 0), F.lit("d")))
            .when(s >= 3600, F.concat(_fixed(d / 3600, 0), F.lit("h")))
            .when(s >= 60, F.concat(_fixed(d / 60, 0), F.lit("m")))
            .otherwise(F.format_string("%ds", s)))


def clock_duration(sec: Column | str) -> Column:
    """HH:MM:SS, with a day count in front past one day."""
    s = F.greatest(col(sec).cast("long"), F.lit(0))
    day = F.floor(s / 86400)
    hms = F.format_string("%02d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(day > 0, F.concat(day.cast("string"), F.lit("d "), hms)).otherwise(hms)


def query_tag(query_id: Column | str) -> Column:
    """Low four hex digits of a statement id."""
    return F.lower(F.lpad(F.hex(col(query_id).cast("long").bitwiseAND(F.lit(65535))), 4, "0"))


def recount_title(title: Column | str, n: Column | str) -> Column:
    """Replace the leading count of a title; other titles stay as they are."""
    return F.when(col(title).rlike(r"^\d+"),
                  F.concat(col(n).cast("string"), F.regexp_replace(col(title), r"^\d+", ""))).otherwise(col(title))


def metric_label(text: Column | str) -> Column:
    """Escape a metric label value: backslash, quote, newline."""
    s = F.replace(col(text), F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit('"'), F.lit('\\"'))
    return F.replace(s, F.lit("\n"), F.lit("\\n"))


# --- object identities -------------------------------------------------------

TYPED_PREFIXES = ("setting:", "slot:", "sub:", "q:", "db:")


def stable_object(obj: Column | str) -> Column:
    """True when an object name can key a suppression: never a bare pid, oid or LSN."""
    o = col(obj)
    typed = F.lit(False)
    has_prefix = F.lit(False)
    for p in TYPED_PREFIXES:
        has_prefix = has_prefix | o.startswith(p)
        typed = typed | (o.startswith(p) & (F.length(o) > len(p)))
    dotted = o.contains(".") & o.rlike(r"[^0-9.]")
    return (o == "") | F.when(has_prefix, typed).otherwise(dotted)


def object_class(obj: Column | str) -> Column:
    o = col(obj)
    return (F.when(o == "", "cluster").when(o.startswith("setting:"), "setting")
            .when(o.startswith("slot:"), "slot").when(o.startswith("sub:"), "sub")
            .when(o.startswith("q:"), "query").when(o.startswith("db:"), "db")
            .when(o.contains("."), "relation").otherwise("cluster"))


def identity_parts(identity: Column | str) -> Column:
    """struct(schema, table, name) of a dotted identity; the table may hold dots itself."""
    parts = F.split(col(identity), r"\.")
    n = F.size(parts)
    return F.struct(
        F.when(n >= 2, parts[0]).otherwise("").alias("schema"),
        F.when(n >= 3, F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(1))), ".")).otherwise("").alias("table"),
        F.element_at(parts, -1).alias("name"))


def quote_ident(name: Column | str) -> Column:
    s = col(name)
    return F.when(s.rlike(r"^[a-z_][a-z0-9_]*$"), s).otherwise(
        F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def index_ddl(schema: Column | str, table: Column | str, columns: Column | str) -> Column:
    return F.concat(F.lit("CREATE INDEX ON "), quote_ident(schema), F.lit("."), quote_ident(table), F.lit(" ("),
                    F.array_join(F.transform(col(columns), quote_ident), ", "), F.lit(")"))


def split_words(name: Column | str) -> Column:
    """Lower-case words of an identifier, cut at separators and at case changes."""
    marked = F.regexp_replace(col(name), r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    return F.filter(F.transform(F.split(marked, r"[_\- ]+"), F.lower), lambda w: w != "")


def _title(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))


def case_variants(name: Column | str) -> Column:
    """The name itself, then camel, snake, Pascal and constant case."""
    words = split_words(name)
    pascal = F.array_join(F.transform(words, _title), "")
    camel = F.concat(words[0], F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), _title), ""))
    snake = F.array_join(words, "_")
    return F.when(F.size(words) == 0, F.array(col(name))).otherwise(
        F.array(col(name), camel, snake, pascal, F.upper(snake)))


def search_terms(columns: Column | str) -> Column:
    """All spellings of all columns, in order, without repeats."""
    every = F.flatten(F.transform(col(columns), case_variants))
    return F.array_distinct(F.filter(every, lambda t: t != ""))
