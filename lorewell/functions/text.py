"""Text functions as columns; those that walk a text line by line are Arrow UDFs."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the depth score and of the classifier.
CAUSAL = (
    r"(?i)\bbecause\b|\bwhen\b.{5,40}\bthen\b|\bwhich\s+(?:causes|leads|means)\b|\bso\s+that\b|\bthe\s+fix\b|\bthis\s+means\b|\bthe\s+cost\b"
    r"|\bcost\s+us\b|\bif\s+you\s+don.t\b|\bwithout\b.{3,30}\byou\b|\bso\s+(?:each|every)\b|→|\bproducing\s+\d"
)
NUMBERS = r"(?i)\b\d+(?:\.\d+)?(?:\s*(?:%|ms|s|MB|GB|KB|bytes|requests?|errors?|times?|x))\b|\b\d{2,}\b"
TOOLS = (
    r"(?i)\b(?:React|Django|Flask|FastAPI|Express|PostgreSQL|Redis|Docker|Kubernetes|Terraform|AWS|Lambda|S3|DynamoDB|Webpack|Vite"
    r"|pytest|Hypothesis|numpy|pandas|scikit-learn|TensorFlow|PyTorch|Node\.js|TypeScript|Rust|Go|Python|Java|Bedrock|pgvector"
    r"|Git|GitHub|npm|pip|cargo|Maven|Gradle)\b"
)
QUESTIONS = r"(?i)questions\s+this\s+answers\s*:"
CONNECTIONS = r"(?i)\b(?:extends|contradicts|relates\s+to|builds\s+on|derived\s+from|inspired\s+by|supports|conflicts\s+with)\b"
PROCEDURAL = r"(?i)step[- ]by[- ]step|\bhow\s+to\b|(?:^|\n)\s*1\.\s+.+(?:\n\s*2\.\s+.+)(?:\n\s*3\.\s+.+)"
SEMANTIC = ("learning", "decision", "pattern", "insight", "schema")
OPAQUE = r"^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32})$"
TRACKERS = r"(?i)^(?:utm_|fbclid|gclid|mc_|ref|sxsrf|ved|ei|oq|gs_l|sca_esv|rlz)"
SECRETS = r"(?i)^(?:token|access_token|auth|key|api_?key|secret|password|session|sig|signature|code)(?:=|$)"

HEADER_END = r"(?m)^[ \t]*---[ \t]*$"


def count_up_to(text: Column, pattern: str, most: int) -> Column:
    """The number of matches, at most `most`: the search ends there."""
    return F.greatest(F.coalesce(F.size(F.split(text, pattern, most + 1)) - 1, F.lit(0)), F.lit(0))


def depth_score(text: Column) -> Column:
    """0 to 1 from seven capped signals of explanation, over the whole text; each is looked for until its cap is reached."""
    capped = lambda most, each, n: F.least(F.lit(most), n * F.lit(each))
    text = F.nullif(text, F.lit(""))
    tools = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOOLS})"), F.lit(1))))
    total = (
        capped(0.35, 0.15, count_up_to(text, CAUSAL, 3))
        + capped(0.20, 0.15, F.floor(count_up_to(text, "```", 4) / 2))
        + F.when(text.rlike(QUESTIONS), 0.25).otherwise(0.0)
        + F.least(F.lit(0.10), count_up_to(text, r"[^\s]+", 100) / 1000.0)
        + capped(0.08, 0.04, count_up_to(text, NUMBERS, 2))
        + capped(0.08, 0.04, F.greatest(F.coalesce(tools, F.lit(0)), F.lit(0)))
        + capped(0.08, 0.04, count_up_to(text, CONNECTIONS, 2))
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def classify(kind: Column, text: Column) -> Column:
    return F.when(text.rlike(PROCEDURAL), "procedural").when(kind.isin(*SEMANTIC), "semantic").otherwise("episodic")


def project_tag(raw: Column) -> Column:
    """The last component of a path, lower case; null for roots and homes, hidden names and opaque ids."""
    plain = F.lower(F.trim(raw))
    parts = F.filter(F.split(F.replace(plain, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    short = plain.startswith("/") & (F.size(F.filter(F.split(plain, "/"), lambda p: p != "")) < 3)
    tag = F.trim(F.when(F.size(parts) > 0, F.element_at(parts, -1)))
    return F.when(short | (F.coalesce(tag, F.lit("")) == "") | tag.startswith(".") | tag.rlike(OPAQUE), None).otherwise(tag)


def header(text: Column) -> Column:
    """The fields before the first line of three dashes as a map: `# ` gives the title, `Key: value` the rest.

    Keys are lower case with underscores; of a key that comes twice the later value counts. A text without such a
    line has its whole length read for fields.
    """
    lines = F.split(F.element_at(F.split(text, HEADER_END, 2), 1), "\n")
    key = lambda s: F.regexp_replace(F.lower(F.trim(s)), r"[\s-]+", "_")
    titled = F.transform(F.filter(lines, lambda s: s.startswith("# ")), lambda s: F.struct(F.lit("title").alias("k"), F.trim(F.substr(s, F.lit(3))).alias("v")))
    keyed = F.transform(F.filter(lines, lambda s: s.contains(":") & ~s.startswith("#")), lambda s: F.struct(key(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.substr(s, F.instr(s, ":") + 1)).alias("v")))
    pairs = F.concat(titled, keyed)
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]))


def body(text: Column) -> Column:
    """What stands below the first line of three dashes; the whole text if there is none."""
    parts = F.split(text, HEADER_END, 2)
    return F.regexp_replace(F.element_at(parts, -1), r"^\s+|\s+$", "")


def html_text(page: Column) -> Column:
    """Text of a page: style, script and head dropped, blocks on lines of their own, entities resolved, space squeezed."""
    plain = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<(style|script|head)\b.*?</\1>", " ")
    plain = F.regexp_replace(plain, r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6]|blockquote)>", "\n")
    plain = unescape(F.regexp_replace(plain, r"<[^>]+>", " "))
    plain = F.regexp_replace(F.regexp_replace(plain, r"[ \t\x{a0}]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references of HTML as the characters they stand for."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking parameters and anything that looks like a credential."""
    bare = F.substring_index(url, "#", 1)
    query = F.when(F.instr(bare, "?") > 0, F.substr(bare, F.instr(bare, "?") + 1)).otherwise(F.lit(""))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKERS) & ~p.rlike(SECRETS)), "&")
    return F.concat(F.substring_index(bare, "?", 1), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def visit_class(url: Column) -> Column:
    """skip, search, chat, app, internal or public, by ordered rules on address and host."""
    h = host(url)
    return (
        F.when((h == "") | ~F.lower(url).rlike(r"^https?://"), "skip")
        .when(url.rlike(r"(?i)/(?:login|signin|oauth|auth|account|checkout)(?:[/?#]|$)") | h.rlike(r"^(?:localhost|127\.|10\.|192\.168\.)"), "skip")
        .when(h.rlike(r"(?:^|\.)(?:google|bing|duckduckgo)\.") & url.rlike(r"[?&]q="), "search")
        .when(h.rlike(r"(?:^|\.)(?:slack|discord|teams)\."), "chat")
        .when(h.rlike(r"^(?:app|mail|calendar|docs)\."), "app")
        .when(h.rlike(r"\.(?:internal|local|corp|lan)$"), "internal")
        .otherwise("public")
    )


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def light_stem(word: Column) -> Column:
    """An English word without its plural ending: -ies as -y, -es as -e, -s dropped, with the usual exceptions."""
    return (
        F.when(word.rlike(r"(?<![ae])ies$") & (F.length(word) > 4), F.regexp_replace(word, r"ies$", "y"))
        .when(word.rlike(r"(?<![aeo])es$") & (F.length(word) > 3), F.regexp_replace(word, r"es$", "e"))
        .when(word.rlike(r"(?<![us])s$") & (F.length(word) > 3) & ~word.rlike(r"ies$|es$"), F.regexp_replace(word, r"s$", ""))
        .otherwise(word)
    )


def match_quote(quote: Column, source: Column) -> Column:
    """verbatim_exact if the quote stands in the source up to white space, verbatim_tokens if its words stand there
    one after the other, else null."""
    plain = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))
    joined = lambda t: F.concat(F.lit("\u0001"), F.array_join(tokens(t), "\u0001"), F.lit("\u0001"))
    return F.when(plain(quote) == "", None).when(plain(source).contains(plain(quote)), "verbatim_exact").when((F.size(tokens(quote)) > 0) & joined(source).contains(joined(quote)), "verbatim_tokens")


def slug(text: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most)


def first_sentence(text: Column, most: int = 220) -> Column:
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    stop = F.regexp_instr(plain, F.lit(r"[.!?](?:\s|$)"))
    return F.substring(F.when(stop > 0, F.substr(plain, F.lit(1), stop)).otherwise(plain), 1, most)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def split_sections(text: str | None, most: int = 4000) -> list[str]:
    """Pieces of at most `most` characters that together are the text.

    A piece ends before a heading, else after an empty line, else after a line, if there is such a place in its
    second half; else after `most` characters.
    """
    out, at = [], 0
    text = text or ""
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            half = at + most // 2
            heading = max((m.start() + 1 for m in re.finditer(r"\n(?=#{2,6}\s)", text[at:end]) if m.start() + 1 >= most // 2), default=0)
            if heading:
                end = at + heading
            elif (p := text.rfind("\n\n", half, end)) >= 0:
                end = p + 2
            elif (p := text.rfind("\n", half, end)) >= 0:
                end = p + 1
        out.append(text[at:end])
        at = end
    return out


def chunks(most: int = 4000):
    """split_sections as a function of a column."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_sections(t, most))

    return cut


def questions_of(text: str | None) -> tuple[str, str]:
    """(questions, rest): the items right below the first line `Questions this answers:`, and what is on that line,
    joined by spaces; the rest keeps the line but not the items."""
    found, rest, inside, seen = [], [], False, False
    for line in (text or "").split("\n"):
        if not seen and line.lower().startswith("questions this answers:"):
            seen = inside = True
            found += [own] if (own := line.partition(":")[2].strip(" \t\r\n")) else []
            rest.append(line)
        elif inside and line[:2] in ("- ", "* "):
            found.append(line[2:])
        else:
            inside = False
            rest.append(line)
    return " ".join(found), "\n".join(rest)


def queries_of(text: str | None) -> list[str]:
    """The items of every such section, one query each; empty lines before the first item are passed over."""
    out, inside = [], False
    for line in map(str.strip, (text or "").split("\n")):
        if line.lower().startswith("questions this answers:"):
            inside = True
            out += [own] if (own := line.partition(":")[2].strip()) else []
        elif inside and line[:2] in ("- ", "* "):
            out.append(line[2:].strip())
        elif inside and out:
            break
    return out


@F.pandas_udf(T.StructType([T.StructField("questions", T.StringType()), T.StructField("rest", T.StringType())]))
def questions(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([questions_of(t) for t in texts], columns=["questions", "rest"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def golden_queries(texts: pd.Series) -> pd.Series:
    return texts.map(queries_of)


def json_in(text: str | None) -> str | None:
    """The JSON of a reply: all of it, else a fenced block, else the longest part that parses."""
    plain = re.sub(r"\x1b\[[0-9;]*m", "", text or "")
    fence = re.search(r"```(?:json)?\s*\n?(.*?)\n?\s*```", plain, re.S)
    for own in (plain.strip(), fence[1].strip() if fence else ""):
        try:
            return json.dumps(json.loads(own, strict=False))
        except ValueError:
            pass
    decoder, best, at = json.JSONDecoder(strict=False), None, 0
    while m := re.compile(r"[{\[]").search(plain, at):
        try:
            value, end = decoder.raw_decode(plain, m.start())
        except ValueError:
            at = m.start() + 1
            continue
        if best is None or end - m.start() > best[0]:
            best = (end - m.start(), value)
        at = end
    return json.dumps(best[1]) if best else None


@F.pandas_udf(T.StringType())
def recovered_json(texts: pd.Series) -> pd.Series:
    return texts.map(json_in)
