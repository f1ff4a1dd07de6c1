"""Entry points of source files: per-line predicates by language, decorated Python functions, surfaces that tags imply."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import any_of

FIELDS = ("line", "end_line", "function_name", "name", "kind", "access_level", "trust_boundary", "access_evidence", "conditions", "provenance", "rationale")
# What marks routes, roles, logins and conditions.
ROUTE_CALLS = (".get(", ".post(", ".put(", ".delete(", ".patch(", ".use(")
ROUTE_OWNERS = ("app", "router", "server")
ROUTE_DECORATORS = ("route", ".get", ".post", ".put", ".delete", ".patch")
ROLES = ("role", "permission", "admin", "owner")
LOGINS = ("login_required", "authenticated", "auth", "jwt_required")
CONDITIONAL = ("feature", "flag", "toggle", "enabled", "disabled", "experiment", "beta", "rollout", "paused")
OWNER_GUARDS = ("onlyOwner", "onlyRole", "requiresAuth")
STATE_GUARDS = ("whenNotPaused", "whenPaused", "featureEnabled")
# Tags, the line-less surface that any of them implies, and its evidence.
TAG_SURFACES = (
    (("parser", "deserialization"), "parser_input", "parser", "public", "attacker_controlled_input", "parser/deserialization file tag"),
    (("network_entry",), "network_surface", "route", "public", "network_request", "network entry file tag"),
    (("auth_boundary",), "auth_boundary", "privileged_surface", "authenticated", "identity_boundary", "auth boundary file tag"),
    (("syscall_entry", "filesystem_entry"), "local_privileged_boundary", "privileged_surface", "local-only", "local_process", "syscall/filesystem file tag"),
)


def _entry(line: Column, end_line: Column, function: Column, name: Column, kind: str | Column, access: str | Column, boundary: str | Column, conditions: Column, evidence: Column) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    kind, access, boundary = as_col(kind), as_col(access), as_col(boundary)
    provenance = F.concat(F.lit("entrypoint:"), kind, F.lit(":"), access)
    rationale = F.concat(kind, F.lit(" surface classified as "), access, F.lit(" at "), boundary)
    values = (line.cast("int"), end_line.cast("int"), function.cast("string"), name, kind, access, boundary, evidence.cast("array<string>"), conditions.cast("array<string>"), provenance, rationale)
    return F.struct(*[v.alias(n) for v, n in zip(values, FIELDS)])


NO_TEXTS = "cast(array() as array<string>)"


def _no_text() -> Column:
    return F.lit(None).cast("string")


def conditional(text: Column) -> Column:
    return any_of(F.lower(text), CONDITIONAL)


def _line_entries(language: Column, line: Column, at: Column) -> Column:
    """The entries that one stripped line makes in a file of its language."""
    own = F.when(conditional(line), F.array(line)).otherwise(F.expr(NO_TEXTS))
    none = F.expr(NO_TEXTS)
    cli = lambda function, name, conditions: _entry(at, at, function, name, "cli", "local-only", "process_invocation", conditions, F.array(line))
    main, fuzz = F.lit("main"), F.lit("LLVMFuzzerTestOneInput")
    handler = F.when(line.contains("function "), F.nullif(F.trim(F.substring_index(F.regexp_extract(line, "function (.*)$", 1), "(", 1)), F.lit(""))).when(line.contains("=>"), F.lit("arrow_handler"))
    name = F.substring_index(F.substring(line, 10, 1 << 20), "(", 1)
    guards = F.filter(F.array(*map(F.lit, STATE_GUARDS)), lambda g: F.contains(line, g))
    callback = F.lower(name).contains("callback") | name.startswith("onERC")
    held = F.filter(F.array(*map(F.lit, OWNER_GUARDS)), lambda g: F.contains(line, g))
    named = F.concat(held, F.when(callback, F.array(F.lit("callback naming convention"))).otherwise(F.expr(NO_TEXTS)))
    shown = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("external/public function")))
    access = F.when(callback, "contract-only/callback").when(any_of(line, OWNER_GUARDS), "role-restricted").otherwise("public")
    script, python, c, solidity = language.isin("javascript", "typescript"), language == "python", language.isin("c", "cpp"), language == "solidity"
    return F.array_compact(
        F.array(
            F.when(script & any_of(line, ROUTE_CALLS) & any_of(line, ROUTE_OWNERS), _entry(at, at, handler, F.lit("http_handler"), "route", "public", "http_request", own, F.array(line))),
            F.when(script & line.contains("process.argv"), cli(_no_text(), F.lit("process.argv"), own)),
            F.when(python & line.startswith("if __name__") & line.contains("__main__"), cli(F.lit("__main__"), F.lit("__main__"), none)),
            F.when(python & any_of(line, ("argparse.", "click.command")), cli(_no_text(), F.lit("cli_parser"), none)),
            F.when(c & (F.concat(F.lit(" "), line).contains(" main(")), cli(main, main, own)),
            F.when(c & line.contains("LLVMFuzzerTestOneInput"), _entry(at, at, fuzz, fuzz, "fuzz", "public", "fuzzer_input", own, F.array(line))),
            F.when(solidity & line.startswith("function ") & any_of(line, (" public", " external")) & ~any_of(line, (" view", " pure")), _entry(at, at, name, name, "smart_contract_state_change", access, "contract_call", guards, shown)),
        )
    )


def line_entry_points(targets: DataFrame) -> DataFrame:
    """(path, line, ...) of the lines that make entry points by themselves."""
    lines = targets.select("path", "language", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    rows = lines.select("path", F.explode(_line_entries(F.col("language"), F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")), F.col("pos") + 1)).alias("e"))
    return rows.select("path", "e.*")


def _conditional(text: str) -> bool:
    return any(t in text.lower() for t in CONDITIONAL)


def decorated_functions(text: str) -> list[dict]:
    """The entries of a Python text's decorated functions; a text that isn't Python has none.

    A route's decorator names one; its access follows from the other decorators, where role marks win over login marks, and
    these are the evidence, or else the route itself. A command is a local entry. Conditions are the conditional decorators and
    the tests of the `if`s in the function's body.
    """
    try:
        tree = ast.parse(text)
        functions = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.decorator_list]
        out = []
        for node in functions:
            decorators = [ast.unparse(d) for d in node.decorator_list]
            routes = [d for d in decorators if any(t in d for t in ROUTE_DECORATORS)]
            tests = [ast.unparse(n.test) for n in ast.walk(node) if isinstance(n, ast.If)]
            entry = {"line": node.lineno, "end_line": node.end_lineno, "function_name": node.name, "conditions": sorted({t for t in decorators + tests if _conditional(t)})}
            marked = [d for d in decorators if d not in routes and any(t in d.lower() for t in ROLES + LOGINS)]
            if routes:
                roles = any(t in d.lower() for d in marked for t in ROLES)
                access = "role-restricted" if roles else "authenticated" if marked else "public"
                out.append({**entry, "kind": "route", "access_level": access, "trust_boundary": "http_request", "access_evidence": marked or routes[:1]})
            if any(".command" in d for d in decorators):
                out.append({**entry, "kind": "cli", "access_level": "local-only", "trust_boundary": "process_invocation", "access_evidence": decorators})
        return out
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


_PYTHON = "path string, line int, end_line int, function_name string, kind string, access_level string, trust_boundary string, access_evidence array<string>, conditions array<string>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    kinds = {"path": pa.string(), "line": pa.int32(), "end_line": pa.int32(), "function_name": pa.string(), "kind": pa.string(), "access_level": pa.string(), "trust_boundary": pa.string(), "access_evidence": texts, "conditions": texts}
    for batch in batches:
        rows = [{"path": p, **e} for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for e in decorated_functions(t)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))


def python_routes(targets: DataFrame) -> DataFrame:
    """(path, line, ...) of Python functions with a route or command decorator, by the syntax tree of each text.

    The entry reaches from the def line to the end of the body, whatever lines decorators, signatures and strings span.
    Only texts that could hold a decorator leave the JVM.
    """
    rows = targets.where("language = 'python'").where(F.col("text").contains("@")).select("path", "text").mapInArrow(_parsed, _PYTHON)
    c = {n: F.col(n) for n in ("line", "end_line", "function_name", "kind", "access_level", "trust_boundary", "access_evidence", "conditions")}
    entry = _entry(c["line"], c["end_line"], c["function_name"], c["function_name"], c["kind"], c["access_level"], c["trust_boundary"], c["conditions"], c["access_evidence"])
    return rows.select("path", entry.alias("e")).select("path", "e.*")


def tag_entry_points(targets: DataFrame) -> DataFrame:
    """(path, ...) of line-less surfaces that a file's tags imply."""
    nothing = F.lit(None).cast("int")
    implied = [F.when(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), _entry(nothing, nothing, _no_text(), F.lit(name), kind, access, boundary, F.expr(NO_TEXTS), F.array(F.lit(said)))) for tags, name, kind, access, boundary, said in TAG_SURFACES]
    return targets.select("path", F.explode(F.array_compact(F.array(*implied))).alias("e")).select("path", "e.*")


def entry_points(targets: DataFrame) -> DataFrame:
    """All entry points of targets (path, language, text, tags), by path, line (last without one) and name."""
    rows = line_entry_points(targets).unionByName(python_routes(targets)).unionByName(tag_entry_points(targets))
    return rows.orderBy("path", F.col("line").asc_nulls_last(), "name")
