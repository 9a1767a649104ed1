"""Small text and label functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Highlight colours by their background, and other names of code languages.
COLORS = {"rgb(255, 243, 205)": "yellow", "rgb(212, 237, 218)": "green", "rgb(204, 231, 255)": "blue", "rgb(248, 215, 218)": "red", "#fff3cd": "yellow", "#d4edda": "green", "#cce7ff": "blue", "#f8d7da": "red"}
LANGUAGE_ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "rs": "rust", "md": "markdown", "sh": "bash", "zsh": "bash", "yml": "yaml", "objc": "objective-c", "objectivec": "objective-c", "obj-c": "objective-c",
    "dockerfile": "docker", "tf": "hcl", "terraform": "hcl", "csharp": "c#", "fsharp": "f#", "vb": "visual basic", "tex": "latex", "asm": "assembly", "wasm": "webassembly", "cpp": "c++", "jsx": "javascript", "tsx": "typescript",
    "plaintext": "plain text", "plain-text": "plain text", "plain_text": "plain text", "text": "plain text", "txt": "plain text",
}
LANGUAGES = [
    "abap", "abc", "agda", "arduino", "ascii art", "assembly", "bash", "basic", "bnf", "c", "c#", "c++", "clojure", "coffeescript", "coq", "css", "dart", "dhall", "diff", "docker", "ebnf", "elixir", "elm", "erlang", "f#", "flow", "fortran",
    "gherkin", "glsl", "go", "graphql", "groovy", "haskell", "hcl", "html", "idris", "java", "javascript", "json", "julia", "kotlin", "latex", "less", "lisp", "livescript", "llvm ir", "lua", "makefile", "markdown", "markup", "matlab",
    "mathematica", "mermaid", "nix", "notion formula", "objective-c", "ocaml", "pascal", "perl", "php", "plain text", "powershell", "prolog", "protobuf", "purescript", "python", "r", "racket", "reason", "ruby", "rust", "sass", "scala", "scheme",
    "scss", "shell", "smalltalk", "solidity", "sql", "swift", "toml", "typescript", "vb.net", "verilog", "vhdl", "visual basic", "webassembly", "xml", "yaml", "java/c/c++/c#",
]
# Words of technical texts.
TECHNICAL_WORDS = """function class method variable constant interface callback async await syntax parameter argument return exception error
api endpoint request response header json xml yaml http https rest graphql
cli command option flag usage install configure build deploy npm git docker kubernetes sdk
javascript python java rust typescript react vue angular node express django flask spring
example tutorial guide reference deprecated version""".split()


def map_color(background: Column) -> Column:
    """The colour name of a background; yellow for any other."""
    out = F.lit("yellow")
    for code, name in COLORS.items():
        out = F.when(background == code, name).otherwise(out)
    return out


def map_code_language(hint: Column) -> Column:
    """The supported language of a hint, by alias or name; null for others."""
    h = F.substr(F.lower(F.trim(hint)), F.lit(1), F.lit(64))
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv))[h], h)
    return F.when(named.isin(LANGUAGES), named)


def technical_terms(text: Column) -> Column:
    """A struct of term_count, word_count, ratio and is_technical (ratio over 0.02, or more than ten terms)."""
    raw = F.coalesce(text, F.lit(""))
    words = F.regexp_count(F.lower(raw), F.lit(r"\b(?:" + "|".join(TECHNICAL_WORDS) + r")\b"))
    n = words + F.regexp_count(raw, F.lit(r"\bGo\b")) + F.regexp_count(F.lower(raw), F.lit(r"(?<![a-z0-9_])c\+\+(?![a-z0-9_])"))
    count = F.regexp_count(raw, F.lit(r"[^\x00-\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"))
    ratio = n / F.greatest(count, F.lit(1))
    return F.struct(n.alias("term_count"), count.alias("word_count"), ratio.alias("ratio"), ((ratio > 0.02) | (n > 10)).alias("is_technical"))


def is_title_consistent(candidate: Column, title: Column) -> Column:
    """Empty or up to four characters: true; else whether the first 15 are in the title, whatever the case."""
    c = F.trim(candidate)
    empty = (F.coalesce(candidate, F.lit("")) == "") | (F.coalesce(title, F.lit("")) == "")
    return F.when(empty | (F.char_length(c) <= 4), True).otherwise(F.contains(F.lower(title), F.lower(F.substr(c, F.lit(1), F.lit(15)))))


def format_title(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced by its value; unknown names and empty values stay as they are."""
    out = template
    for name, value in values.items():
        mark = F.lit("{" + name + "}")
        out = F.when(F.coalesce(value, F.lit("")) == "", out).otherwise(F.replace(out, mark, value))
    return out


def highlight_annotation(style: Column, color: Column) -> Column:
    """COLOR_SYNC gives <color>_background, COLOR_TEXT the colour, BOLD bold; null for NONE and others."""
    c = F.when(color.isin("yellow", "green", "blue", "red"), color).otherwise("yellow")
    return F.when(style == "COLOR_SYNC", F.concat(c, F.lit("_background"))).when(style == "COLOR_TEXT", c).when(style == "BOLD", "bold")


def remote_url(page_id: Column, url: Column, base: str) -> Column:
    """The stored url, or one made of base and the id without dashes; null without an id."""
    return F.when(F.coalesce(page_id, F.lit("")) != "", F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit(base), F.replace(page_id, F.lit("-"), F.lit("")))))


def truncate(s: Column, n: int, mark: str = "…") -> Column:
    """At most n characters, the mark after what was cut."""
    return F.when(F.char_length(s) > n, F.concat(F.substr(s, F.lit(1), F.lit(n)), F.lit(mark))).otherwise(s)


# Words of error messages and the codes they mean, in the order they are tried.
ERROR_WORDS = [
    ("RATE_LIMITED", ["rate limit", "too many requests"]),
    ("NO_TAB_WITH_ID", ["no tab with id"]),
    ("CONTENT_SCRIPT_NOT_READY", ["receiving end does not exist"]),
    ("TAB_COMMUNICATION_FAILED", ["could not establish connection"]),
    ("MISSING_PAGE_ID", ["not found", "does not exist"]),
    ("NO_ACTIVE_TAB", ["active tab"]),
    ("TIMEOUT", ["timeout", "timed out"]),
    ("NETWORK_ERROR", ["network", "fetch", "enotfound"]),
    ("INTEGRATION_DISCONNECTED", ["integration disconnected", "invalid_token"]),
    ("INVALID_API_KEY_FORMAT", ["invalid api key", "malformed_token"]),
    ("INTEGRATION_FORBIDDEN", ["forbidden", "permission_denied", "permission denied"]),
    ("API_KEY_NOT_CONFIGURED", ["unauthorized", "authentication", "api key", "api_key", "api_token", "api token", "bearer token"]),
    ("VALIDATION_ERROR", ["validation", "image", "media", "conflict", "bad request", "invalid", "400"]),
]


def classify_error(code: Column, message: Column) -> Column:
    """The class of an error: by its code (validation errors on images apart), else by the first words its message holds;
    a message in Chinese characters stays as it is, all else is UNKNOWN_ERROR."""
    text = F.coalesce(message, F.lit(""))
    low = F.lower(text)
    any_of = lambda words: low.rlike("|".join(words))
    picture = F.when(any_of(["image", "media"]), "IMAGE_VALIDATION_ERROR").otherwise("VALIDATION_ERROR")
    out = F.when(F.coalesce(code, F.lit("")) != "", F.when(code == "validation_error", picture).otherwise(F.upper(code)))
    for name, words in ERROR_WORDS:
        out = out.when(any_of(words), name)
    out = out.when(any_of(["permission", "access denied"]), F.when(low.contains("database"), "DATABASE_ACCESS_DENIED").otherwise("TAB_RESTRICTED_PAGE"))
    out = out.when(any_of(["database", "object_not_found"]), "MISSING_DATA_SOURCE")
    out = out.when(low.contains("internal") & low.contains("error") | low.contains("service") & low.contains("unavailable"), "INTERNAL_SERVER_ERROR")
    return out.when(F.substr(text, F.lit(1), F.lit(500)).rlike(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}]"), text).otherwise("UNKNOWN_ERROR")
