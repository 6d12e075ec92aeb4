"""Text and path expressions with the collation rules of the graph model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The characters at which a search text is cut.
SEPARATORS = " \t\r\n.:-_/\\()[]<>,;*"
# Latin letters and what they are indexed as.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), body).getItem(0)


def ascii_fold(c: Column) -> Column:
    """Fold A-Z only: the case rule of name lookup and of substring search."""
    return F.translate(c, UPPER, LOWER)


def index_fold(c: Column) -> Column:
    """Lower case without accents: the form in which terms are indexed."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def index_terms(c: Column) -> Column:
    """Terms of a text in order: runs of letters and digits, folded."""
    return F.array_remove(F.split(index_fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def search_tokens(text: str) -> list[str]:
    """Distinct tokens of a search text, first spelling kept."""
    for s in SEPARATORS:
        text = text.replace(s, "\n")
    seen: dict[str, str] = {}
    for token in text.split("\n"):
        if token:
            seen.setdefault(token.lower(), token)
    return list(seen.values())


def match_phrases(text: str) -> list[list[str]]:
    """The phrases of a search text: each usable token as the terms it is
    indexed as; the last term of a phrase is a prefix."""
    import re
    import unicodedata

    out = []
    for token in search_tokens(text):
        if len(token) >= 2 and any(ch.isalnum() for ch in token):
            folded = "".join(ch for ch in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(ch))
            out.append([t for t in re.split(r"[\W_]+", folded) if t])
    return [p for p in out if p]


def match_expression(text: str) -> str:
    """The same as text, for display: quoted prefixes joined by OR."""
    usable = [t for t in search_tokens(text) if len(t) >= 2 and any(ch.isalnum() for ch in t)]
    return " OR ".join('"{}"*'.format(t.replace('"', '""')) for t in usable)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count two."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x{0}-\x{FFFF}]", ""))


def uri_encode(c: Column) -> Column:
    """Percent-encoding that leaves only unreserved characters."""
    e = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def uri_decode(c: Column) -> Column:
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def slug(c: Column) -> Column:
    """Letters and digits, anything between them one dash; never empty."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("section")).otherwise(s)


def normal_path(c: Column) -> Column:
    """Forward slashes, no outer spaces, no leading or trailing slash."""
    return F.regexp_replace(F.translate(F.trim(c), "\\", "/"), r"^/+|/+$", "")


def parent_path(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit(""))


def file_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    """With its dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(c), r"(\.[^.]+)$", 1))


# Extensions by kind and language.
MARKDOWN = (".md", ".markdown", ".mdown", ".mkd")
SOURCE = (".cs", ".ts", ".tsx")
PROJECT = (".csproj", ".sln", ".slnx")


def document_kind(path: Column) -> Column:
    e = extension(path)
    named = file_name(path).rlike(r"^tsconfig.*\.json$") | e.isin(*PROJECT)
    return F.when(e.isin(*SOURCE), "Source").when(named, "ProjectFile").when(e.isin(*MARKDOWN), "Markdown").otherwise("Other")


def language(ext: Column) -> Column:
    return F.when(ext == ".cs", "C#").when(ext == ".ts", "TypeScript").when(ext == ".tsx", "TSX").when(ext.isin(*MARKDOWN), "Markdown").otherwise("Other")


def trimmed_name(name: Column, node_type: Column) -> Column:
    """A method's name without its parameters."""
    return F.when(node_type == "Method", F.substring_index(name, "(", 1)).otherwise(name)


def edge_label(edge_type: Column) -> Column:
    return F.when(edge_type == "HttpRequest", "http-request").otherwise(F.lower(edge_type))


def node_label(canonical: Column, name: Column) -> Column:
    """``VERB url`` of an http node, name or name/export of a package node."""
    part = F.split(canonical, ":")
    http = F.concat_ws(" ", F.get(part, F.lit(1)), uri_decode(F.get(part, F.lit(2))))
    package = F.concat_ws("/", uri_decode(F.get(part, F.lit(1))), uri_decode(F.get(part, F.lit(2))))
    return F.when(canonical.startswith("http:"), http).when(canonical.startswith("package:"), package).otherwise(F.coalesce(name, canonical))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double precision."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
