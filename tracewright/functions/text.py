"""Column expressions over source text: language, size, tags, match places, normalisation, redaction, chunk ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffix to language.
LANGUAGE_BY_SUFFIX = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".java": "java", ".groovy": "groovy", ".tpl": "groovy", ".kt": "kotlin", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift", ".sol": "solidity",
}
# A tag is set by any of its lower-case substrings in the path or the text.
TAG_TOKENS = {
    "parser": ("parse", "parser", "decode", "lexer"),
    "crypto": ("crypto", "cipher", "hash", "hmac", "rsa", "ecdsa", "encrypt", "decrypt"),
    "auth_boundary": ("auth", "login", "permission", "jwt", "session"),
    "deserialization": ("deserialize", "pickle", "yaml.load", "json.parse", "unmarshal"),
    "syscall_entry": ("exec(", "system(", "popen", "subprocess", "fork(", "spawn"),
    "network_entry": ("socket", "listen(", "accept(", "http", "route", "endpoint"),
    "filesystem_entry": ("open(", "readfile", "writefile", "filepath", "pathlib", "fs."),
    "fuzzable": ("llvmfuzzertestoneinput",),
}
MEMORY_UNSAFE = ("c", "cpp")
HASH_COMMENTS = ("python", "ruby", "shell", "yaml")
REDACTED = "***REDACTED***"
# What is masked, in this order, and what stays of it.
REDACTIONS = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", REDACTED),
    (r"(Bearer\s+)[A-Za-z0-9._\-]{12,}", "$1" + REDACTED),
    (r"\bsk-[A-Za-z0-9._\-]{16,}", REDACTED),
    (r"\bAKIA[0-9A-Z]{16}\b", REDACTED),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}", REDACTED),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}", REDACTED),
    (r"\bAIza[A-Za-z0-9_\-]{20,}", REDACTED),
    (r"([a-zA-Z][a-zA-Z0-9+.\-]*://[^\s:/@]+:)[^\s:/@]{3,}(@)", "$1" + REDACTED + "$2"),
    (r"""(?i)\b(api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key)\b(\s*[=:]\s*)(['"]?)[A-Za-z0-9/+_\-]{8,}\3""", "$1$2$3" + REDACTED + "$3"),
)


def any_of(text: Column, tokens: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in tokens))


def chosen(pairs: dict[str, Column]) -> Column:
    """The sorted names whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs.items()])))


def clean_text(content: Column) -> Column:
    """Bytes as text: invalid UTF-8 is dropped and line ends become newlines."""
    return F.regexp_replace(F.regexp_replace(content.cast("string"), "\ufffd", ""), "\r\n?", "\n")


def language_of(path: Column, text: Column) -> Column:
    """By the file's suffix; else by the first line of a script; else 'unknown'."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    by_suffix = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_SUFFIX.items() for x in pair])
    first = F.lower(F.trim(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)))
    script = F.when(first.startswith("#!") & first.contains("python"), "python").when(first.startswith("#!") & first.contains("node"), "javascript").otherwise("unknown")
    return F.coalesce(F.try_element_at(by_suffix, suffix), script)


def lines_of_code(text: Column) -> Column:
    """Lines that hold more than white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"(?U)\S")))


def tags_of(path: Column, language: Column, text: Column) -> Column:
    hay = F.lower(F.concat(F.coalesce(path, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return chosen({"memory_unsafe": language.isin(*MEMORY_UNSAFE), **{tag: any_of(hay, tokens) for tag, tokens in TAG_TOKENS.items()}})


def redacted(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), REDACTIONS, text)


def normalised(text: Column) -> Column:
    """Lower case, '-' and '_' as spaces, white space collapsed, two synonyms spelled out."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.regexp_replace(low, "memcpy", "memcpy memory copy")
    low = F.regexp_replace(low, "copies", "copy")
    return F.trim(F.regexp_replace(F.translate(low, "-_", "  "), r"\s+", " "))


def chunk_id(path: Column, start: Column, end: Column, text: Column) -> Column:
    """The place, and the digest of place and text: equal texts in two places are two chunks."""
    whole = F.concat_ws(":", path, start.cast("string"), end.cast("string"), text)
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), F.substring(F.sha2(whole, 256), 1, 16))


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)
