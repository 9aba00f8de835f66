"""Text, number, date, code and URL functions. Everything is a built-in Column expression; no Python runs for a row."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
ISO3 = r"^[A-Z]{3}\z"
#: Markers that the info column of an executed element can hold.
MARKERS = ("F", "x", "!", "<", "<<", "q", "e", "*", "b", "REP")
#: Labels of segments at the end of a score sheet's title, in the order in which they are tried.
SEGMENT_LABELS = ("PATTERN DANCE 1 (WITHOUT KEY POINTS)", "PATTERN DANCE 2 (WITHOUT KEY POINTS)", "SHORT PROGRAM", "FREE SKATING", "RHYTHM DANCE", "FREE DANCE", "PATTERN DANCE")
#: Role groups of officials by their function in lower case.
ROLES = {"referee": "referee", "technical controller": "technical_panel", "technical specialist": "technical_panel", "assistant technical specialist": "technical_panel", "data operator": "event_operations", "replay operator": "event_operations"}
#: Streams of the kinds of registered sources.
STREAMS = {"result_ISU": "ISU", "result_NonISU": "NonISU", "result_DP": "DP"}


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def normalize_name(c: Column) -> Column:
    """Upper case with single spaces, by Unicode's white space."""
    return F.upper(F.btrim(F.regexp_replace(c, SPACE, " ")))


def normalize_alias(c: Column) -> Column:
    """Lower case with single spaces; only spaces are trimmed."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def clean_text(c: Column) -> Column:
    """No-break spaces and replacement characters are spaces; white space collapses."""
    return F.btrim(F.regexp_replace(F.translate(c, " �", "  "), SPACE, " "))


def clean_date(c: Column) -> Column:
    """A date text without a word that closes a date, a dot that stands alone, and dots at the end; dashes stay as they are."""
    c = F.regexp_replace(clean_text(c), r"(?<=\d)\s+[^\d\s-]+(?=\s*(?:-|\z))", "")
    return blank_to_null(F.btrim(F.regexp_replace(F.regexp_replace(c, r"\s+\.\s+", " "), r"\s*\.+\z", "")))


def to_int(c: Column) -> Column:
    """A whole number, with or without #; null for anything else."""
    c = F.trim(F.replace(c, F.lit("#"), F.lit("")))
    return F.when(c.rlike(r"^-?\d+\z"), c.try_cast("int"))


def to_float(c: Column, kind: str = "decimal(10,3)") -> Column:
    """A number, with or without #; null for anything else."""
    c = F.trim(F.replace(c, F.lit("#"), F.lit("")))
    return F.when(c.rlike(r"^-?\d+(\.\d+)?\z"), c.try_cast(kind))


def percent(c: Column) -> Column:
    return to_float(F.replace(c, F.lit("%"), F.lit("")))


def _matched(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of a match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def parse_event_start(c: Column) -> Column:
    """The first day of a date range in one of its layouts.

    The text before " - ", else its first D.M.YYYY, else D.M with the year of the range's end. A date with slashes is
    month-first only if that alone is possible; all others are day-first. Impossible days give null.
    """
    full = r"^\d{1,2}[./]\d{1,2}[./]\d{4}"
    short = r"^(\d{1,2})[./](\d{1,2})\s*-\s*\d{1,2}[./]\d{1,2}[./](\d{4})\z"
    head = F.regexp_extract(F.split_part(c, F.lit(" - "), F.lit(1)), full + r"\z", 0)
    source = F.coalesce(blank_to_null(head), blank_to_null(F.regexp_extract(c, full, 0)), F.when(c.rlike(short), F.regexp_replace(c, short, "$1.$2.$3")))

    def date(parts: Column) -> Column:
        a, b, year = (F.get(parts, F.lit(i)) for i in range(3))
        month_first = (a.cast("int") <= 12) & (b.cast("int") >= 13) & (b.cast("int") <= 31)
        return F.concat_ws("-", year, F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a)).try_cast("date")

    return F.get(F.transform(F.array(F.split(source, "[./]")), date), F.lit(0))  # the parts are found once


def season(date: Column) -> Column:
    """Seasons begin in July: 2013/2014."""
    first = F.year(date) - F.when(F.month(date) >= 7, 0).otherwise(1)
    return F.concat(first.cast("string"), F.lit("/"), (first + 1).cast("string"))


def nation_code(c: Column) -> Column:
    """Three capitals that are the text or stand at its end."""
    return _matched(F.trim(c), r"\b([A-Z]{3})\z")


def split_title(c: Column) -> Column:
    """(category, segment) at the first " - "."""
    parts = F.split(c, " - ", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("category"), F.trim(F.get(parts, F.lit(1))).alias("segment"))


def split_sheet_title(c: Column) -> Column:
    """(category, segment): a known label at the end, else the first two parts between runs of spaces, else all and nothing."""
    parts = F.filter(F.transform(F.split(c, "  "), F.btrim), lambda x: x != "")
    cut = F.size(parts) >= 2
    category, segment = F.when(cut, F.get(parts, F.lit(0))).otherwise(c), F.when(cut, F.get(parts, F.lit(1))).otherwise("")
    for label in reversed(SEGMENT_LABELS):
        here = F.endswith(F.upper(c), F.lit(f" {label}"))
        category = F.when(here, F.btrim(F.left(c, F.length(c) - len(label) - 1))).otherwise(category)
        segment = F.when(here, F.lit(label)).otherwise(segment)
    return F.struct(category.alias("category"), segment.alias("segment"))


def classify_role(function: Column) -> Column:
    """(role_group, judge_number) of an official's function."""
    f = F.lower(clean_text(function))
    number = _matched(f, r"^judge\s+no\.?\s*(\d+)").try_cast("int")
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    group = F.when(number.isNotNull(), "judge").otherwise(F.coalesce(F.try_element_at(known, f), F.lit("other")))
    return F.struct(group.alias("role_group"), number.alias("judge_number"))


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def source_context(url: Column, streams: tuple[str, ...] = ("isu", "nonisu")) -> Column:
    """(host, path, stream): the stream is the first part of the path that names one."""
    parts = F.filter(F.split(F.lower(F.coalesce(url_path(url), F.lit(""))), "/"), lambda x: x.isin(*streams))
    return F.struct(url_host(url).alias("host"), url_path(url).alias("path"), F.get(parts, F.lit(0)).alias("stream"))


def raw_path(url: Column) -> Column:
    """The path as it stands in the URL, without parameters of its last part; also of URLs that aren't well formed."""
    return F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r";[^/]*\z", "")


def path_prefix(url: Column) -> Column:
    """The path of an event without outer slashes: without its index page, or the folder of a PDF."""
    p = F.btrim(raw_path(url), F.lit("/"))
    index = r"(?i)/index\.html?\z"
    return F.when(p.rlike(index), F.regexp_replace(p, index, "")).when(F.lower(p).endswith(".pdf"), F.regexp_replace(p, r"/[^/]*\z", "")).otherwise(p)


def profile_key(url: Column, family: str = "bsf_discovered") -> Column:
    """Family, 48 characters of a readable slug of the path prefix and eight digits of its hash."""
    prefix = path_prefix(url)
    slug = F.btrim(F.regexp_replace(F.lower(prefix), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat(F.lit(f"{family}_"), F.substring(slug, 1, 48), F.lit("_"), F.substring(F.sha1(prefix), 1, 8))


def stream_of(kind: Column, url: Column) -> Column:
    """The competition stream of a registered source: by its kind, else by its path."""
    known = F.create_map(*[F.lit(x) for pair in STREAMS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.when(url.contains("/test-mf/"), F.lit("club_test")).otherwise("club"))


def representation_of(kind: Column) -> Column:
    """What skaters stand for in a registered source."""
    return F.when(kind.isin("result_ISU", "result_NonISU"), "nation").otherwise("club")


#: Media types by the ending of a file name.
MEDIA_TYPES = {
    ".css": "text/css", ".csv": "text/csv", ".doc": "application/msword", ".gif": "image/gif", ".htm": "text/html", ".html": "text/html", ".ico": "image/vnd.microsoft.icon", ".jpeg": "image/jpeg", ".jpg": "image/jpeg",
    ".js": "text/javascript", ".json": "application/json", ".mp4": "video/mp4", ".pdf": "application/pdf", ".png": "image/png", ".svg": "image/svg+xml", ".txt": "text/plain", ".xls": "application/vnd.ms-excel", ".xml": "text/xml", ".zip": "application/zip",
}


def document_type(url: Column) -> Column:
    """judges_scores_pdf for a PDF, else the media type that the file name's ending stands for; pages and other endings are html."""
    path = F.lower(raw_path(url))
    types = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    guessed = F.try_element_at(types, F.regexp_extract(path, r"(\.[^./]+)\z", 1))
    return F.when(path.endswith(".pdf"), "judges_scores_pdf").otherwise(F.when(guessed == "text/html", "html").otherwise(F.coalesce(guessed, F.lit("html"))))


def parser_of(profile: Column, url: Column, text: Column | None = None) -> Column:
    """The parser for a source: what its page says, else its profile's, else the one of its time."""
    chosen = F.when(profile.eqNullSafe(F.lit("old_isucalcfs")) | url.contains("/2013/"), "old_isucalcfs").otherwise("fs_manager")
    if text is None:
        return chosen
    t = F.lower(text)
    return F.when(t.contains("isucalcfs"), "old_isucalcfs").when(t.contains("fs manager") | t.contains("judgesdetailsperskater"), "fs_manager").otherwise(chosen)


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def _quoted(c: Column) -> Column:
    """Percent encoding of all but letters, digits and ``_.-~``."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def archive_path(url: Column) -> Column:
    """Where a document is archived: host and path, an index page for folders and names without a dot, and the query in the name."""
    host = F.coalesce(blank_to_null(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("_no_host"))
    raw = raw_path(url)
    path = F.coalesce(blank_to_null(F.btrim(raw, F.lit("/"))), F.lit("index"))
    folder = raw.endswith("/") | ~F.regexp_extract(path, r"([^/]*)\z", 1).contains(".")
    path = F.when(folder, F.concat(F.rtrim(path, F.lit("/")), F.lit("/index.html"))).otherwise(path)
    read = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    names = F.transform(pairs, lambda x: F.concat(_quoted(read(F.get(F.split(x, "=", 2), F.lit(0)))), F.lit("-"), _quoted(read(F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit(""))))))
    return F.concat(host, F.lit("/"), path, F.when(F.size(pairs) > 0, F.concat(F.lit("__query_"), F.array_join(names, "_"))).otherwise(F.lit("")))


def base_element(code: Column) -> Column:
    """An element's code without its markers, part by part of a combination."""
    part = lambda x: F.regexp_replace(F.regexp_replace(x, r"[<!*]", ""), r"(?<=[0-9A-Za-z])[qeb]\z", "")
    return F.array_join(F.transform(F.split(code, r"\+"), lambda x: F.when(x == "COMBO", x).otherwise(part(x))), "+")


def element_markers(code: Column, info: Column) -> Column:
    """Markers in the code, part by part of a combination, and then in the info column, once each."""
    held = lambda x: F.array(
        F.when(x.contains("!"), "!"), F.when(x.contains("<<"), "<<").when(x.contains("<"), "<"), F.when(x.endswith("q"), "q"), F.when(x.endswith("e"), "e"), F.when(x.endswith("b"), "b"), F.when(x.contains("*"), "*")
    )
    inside = F.flatten(F.transform(F.split(F.coalesce(code, F.lit("")), r"\+"), held))
    beside = F.filter(F.split(F.coalesce(info, F.lit("")), r"[\s|]+"), lambda x: x.isin(*MARKERS))
    return F.array_distinct(F.array_compact(F.concat(inside, beside)))


def choose_by(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first rule that holds: labels of buckets, kinds of events, status texts, priorities."""
    out = F.lit(default)
    for when, value in reversed(rules):
        out = F.when(when, F.lit(value)).otherwise(out)
    return out


def catalog_kind(name: Column) -> Column:
    """The kind of a catalog's event by words in its name."""
    return choose_by([(name.contains("Adult Competition"), "isu_adult_catalog"), (name.contains("International") | name.contains("Challenger Series"), "isu_international_catalog")], "isu_official_catalog")


def append_note(old: Column, new: Column) -> Column:
    return blank_to_null(F.concat_ws("\n", old, new))


def keep_imported(old: Column, new: Column) -> Column:
    """A status that is ``imported`` stays."""
    return F.when(old == "imported", old).otherwise(F.coalesce(new, old))


# Predicates.


def non_blank(c: Column) -> Column:
    return c != ""


def not_iso3(c: Column) -> Column:
    """Unknown for null, like the negated match in SQL."""
    return ~c.rlike(ISO3)


def lower_fragment(c: Column) -> Column:
    return c.rlike(r"^[a-z]{3}\z")


def has_header_sequence(text: Column, names: list[str]) -> Column:
    """Whether the names follow one another in the text, whatever stands between them."""
    return text.rlike("(?is)" + ".*?".join(f"\\Q{x}\\E" for x in names))


def has_marker(markers: Column, marker: str) -> Column:
    return F.array_contains(markers, marker)


def has_key(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def has_suffix(c: Column, suffixes: list[str]) -> Column:
    return c.rlike(" (" + "|".join(f"\\Q{x}\\E" for x in suffixes) + r")\z")


def missing_or_zero(*columns: Column) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | c.isNull() | (c == 0)
    return found


def has_headers(headers: Column, expected: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, expected)), headers)) == 0


def join_url(base: Column, ref: Column) -> Column:
    """The whole address of a reference on the page ``base``, with steps up and in place taken; null for a null reference."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    page = F.regexp_replace(F.substr(base, F.length(origin) + 1), r"[?#].*$", "")
    tail = F.regexp_extract(ref, r"[?#].*$", 0)
    path = F.regexp_replace(ref, r"[?#].*$", "")
    folder = F.regexp_replace(page, r"[^/]*\z", "")
    full = F.when(path == "", page).when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    full = F.regexp_replace(full, r"/(\.\.?)\z", "/$1/")
    root = F.array(F.lit("")).cast("array<string>")
    up = lambda held: F.when(F.size(held) > 1, F.slice(held, 1, F.size(held) - 1)).otherwise(held)
    steps = F.aggregate(F.split(F.regexp_replace(full, "^/", ""), "/", -1), root, lambda held, x: F.when(x == "..", up(held)).when(x == ".", held).otherwise(F.concat(held, F.array(x))))
    kept = F.concat(origin, F.when(full.contains("/.") & full.startswith("/"), F.array_join(steps, "/")).otherwise(full), tail)
    kept = F.when(ref == "", base).when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref)).otherwise(kept)
    return F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0), ref)).otherwise(kept)
