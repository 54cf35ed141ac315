"""Detection rules. A rule turns (path, content) of one file into an array of facts.

All rules are evaluated in ONE projection over the files and exploded once, so the content is read a
single time however many rules there are. Facts are small; the long rule texts are attached at the end.
Rules are SQL expressions over the columns ``path`` and ``content``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.text import (
    any_of, contains_any, first_match_line, literal, match_group, match_lines, matches,
)

FACT = "struct<fact:string,check_no:int,phase:int,step:int,pos:int,line:int,arg:string>"
BASE = "substring_index(path, '/', -1)"


@dataclass(frozen=True)
class Rule:
    """``find`` yields ``array<FACT>`` or null; ``guard`` decides cheaply whether the rule may match."""

    name: str
    scope: str
    find: str
    guard: str = "true"
    texts: tuple[tuple[str, tuple], ...] = ()


def fact(code: str, check_no: int, step: int, pos: str, line: str, arg: str = "NULL", phase: int = 0) -> str:
    """SQL of one fact; ``code`` and ``arg`` are SQL expressions."""
    return (
        f"named_struct('fact', {code}, 'check_no', {check_no}, 'phase', {phase}, 'step', {step}, "
        f"'pos', CAST({pos} AS INT), 'line', CAST({line} AS INT), 'arg', CAST({arg} AS STRING))"
    )


def every_match(
    code: str, check_no: int, pattern: str, group: int | None = None, step: int = 0, phase: int = 0, arg: str = "m.g"
) -> str:
    """One fact per match; ``arg`` is an expression over ``m.g``, the text of ``group``."""
    if group is None:
        one = fact(literal(code), check_no, step, "i", "line", phase=phase)
        return f"transform({match_lines(pattern)}, (line, i) -> {one})"
    one = fact(literal(code), check_no, step, "i", "m.line", arg, phase)
    return f"transform({_with_groups(pattern, g=group)}, (m, i) -> {one})"


def first_match(code: str, check_no: int, pattern: str, step: int = 0, arg: str = "NULL") -> str:
    one = fact(literal(code), check_no, step, "0", first_match_line(pattern), arg)
    return f"IF({matches('content', pattern)}, array({one}), NULL)"


def _with_groups(pattern: str, **groups: int) -> str:
    columns = [match_lines(pattern), *(match_group(pattern, g) for g in groups.values())]
    zipped = f"arrays_zip({', '.join(columns)})"
    fields = ", ".join(f"'{n}', z.`{i}`" for i, n in enumerate(("line", *groups)))
    return f"transform({zipped}, z -> named_struct({fields}))"


def _public_variables() -> str:
    tier = (
        f"CASE WHEN {matches('m.g', fv.TIER_ONE_NAME)} THEN 'A1' WHEN {matches('m.g', fv.TIER_TWO_NAME)} THEN 'A1B' END"
    )
    facts = f"transform({_with_groups(fv.PUBLIC_VARIABLE, g=1)}, (m, i) -> {fact(tier, 1, 0, 'i', 'm.line', 'm.g')})"
    return f"filter({facts}, f -> f.fact IS NOT NULL AND NOT {matches('f.arg', fv.PUBLIC_BY_DESIGN)})"


def _client_service_role() -> str:
    hit = f"{matches('content', fv.USE_CLIENT)} AND {contains_any(['SERVICE_ROLE', 'service_role'])}"
    return f"IF({hit}, array({fact(literal('A2'), 1, 1, '0', first_match_line(fv.SERVICE_ROLE))}), NULL)"


def _database_urls() -> str:
    found = _with_groups(fv.DATABASE_URL, password=2, host=3)
    one = fact(literal("A3"), 1, 2, "i", "m.line")
    numbered = f"transform({found}, (m, i) -> named_struct('f', {one}, 'password', m.password, 'host', m.host))"
    real = (
        f"filter({numbered}, m -> NOT {matches('m.host', fv.LOCAL_HOST)}"
        f" AND NOT {matches('m.password', fv.PLACEHOLDER_PASSWORD)}"
        f" AND NOT {matches('m.password', fv.BRACKETED_PASSWORD)})"
    )
    return f"transform({real}, m -> m.f)"


# A text without any of these words cannot match the hints; the byte search spares most files the regex.
_AUTH_WORDS = ["getUser", "getSession", "getServerSession", "require", "urrentUser", "verify", "withApiAuth", "@clerk/"]
_DATA_WORDS = [".from", "supabase", "prisma", "drizzle", "sql`", "pool.query", "db."]
HAS_AUTH_HINT = f"({contains_any(_AUTH_WORDS)} AND {matches('content', any_of(fv.AUTH_HINTS))})"
HAS_DATA_HINT = f"({contains_any(_DATA_WORDS)} AND {matches('content', any_of(fv.DATA_HINTS))})"


def _open_entry_point() -> str:
    route, api, action = (literal(k) for k in fv.ENTRY_POINT_KINDS)
    kind = (
        f"CASE WHEN {matches(BASE, fv.ROUTE_FILE_NAME)} AND {matches('path', fv.APP_DIRECTORY)} THEN {route}"
        f" WHEN {matches('path', fv.PAGES_API_DIRECTORY)} THEN {api}"
        f" WHEN contains(content, 'use server') AND {matches('content', fv.USE_SERVER)} THEN {action} END"
    )
    hit = f"{kind} IS NOT NULL AND {HAS_DATA_HINT} AND NOT {HAS_AUTH_HINT}"
    return f"IF({hit}, array({fact(literal('C'), 3, 0, '0', '1', kind)}), NULL)"


def _header_config() -> str:
    patterns = [fv.HEADERS_FUNCTION, fv.CONTENT_POLICY_HEADER, fv.TRANSPORT_HEADER]
    configured = " OR ".join(matches("content", p) for p in patterns)
    state = f"IF({configured}, 'set', 'missing')"
    return f"array({fact(literal('D.config'), 4, 0, '0', '1', state)})"


def _credentials() -> str:
    words = [["AKIA"], ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], ["k_live_"], ["xox"]]
    found = [
        f"IF({contains_any(w)}, {first_match('E1', 5, p, step, literal(label))}, NULL)"
        for step, ((label, p), w) in enumerate(zip(fv.CREDENTIAL_FORMATS, words))
    ]
    block = first_match("E2", 5, fv.PRIVATE_KEY_BLOCK, len(found))
    found.append(f"IF({contains_any(['-----BEGIN'])}, {block}, NULL)")
    return f"flatten(array_compact(array({', '.join(found)})))"


def _raw_html() -> str:
    found = _with_groups(fv.RAW_HTML, g=1)
    one = fact(literal("H"), 8, 0, "i", "m.line")
    numbered = f"transform({found}, (m, i) -> named_struct('f', {one}, 'g', m.g))"
    kept = (
        f"filter({numbered}, m -> NOT {matches('m.g', fv.STATIC_TEXT)} AND NOT {matches('m.g', fv.SANITIZED_TEXT)})"
    )
    return f"transform({kept}, m -> m.f)"


def _any_case(word: str) -> str:
    return contains_any([word], "lower(content)")


def _text(*codes: str):
    return tuple((code, fv.RULE_TEXT[code]) for code in codes)


DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "public_variable", "code", _public_variables(), contains_any(["process.env.NEXT_PUBLIC_"]), _text("A1", "A1B")
    ),
    Rule("client_service_role", "code", _client_service_role(), contains_any(["use client"]), _text("A2")),
    Rule("database_url", "code", _database_urls(), contains_any(["postgres"]), _text("A3")),
    Rule(
        "created_table", "sql", every_match("B.created", 2, fv.CREATE_TABLE, 1, phase=1, arg="lower(m.g)"),
        _any_case("create"), _text("B1"),
    ),
    Rule(
        "row_security", "sql", every_match("B.secured", 2, fv.ENABLE_ROW_SECURITY, 1, arg="lower(m.g)"),
        _any_case("security"),
    ),
    Rule("permissive_policy", "sql", every_match("B2", 2, fv.PERMISSIVE_POLICY), _any_case("true"), _text("B2")),
    Rule("open_entry_point", "code", _open_entry_point(), texts=_text("C")),
    Rule(
        "middleware_guard", "code", f"IF({HAS_AUTH_HINT}, array({fact(literal('C.middleware'), 3, 0, '0', '1')}), NULL)",
        f"{BASE} IN ({', '.join(literal(n) for n in fv.MIDDLEWARE_NAMES)})",
    ),
    Rule(
        "header_config", "code", _header_config(),
        f"contains(path, 'next.config.') AND {matches('path', fv.HEADER_CONFIG_FILE)}", _text("D"),
    ),
    Rule("credential", "code", _credentials(), f"NOT {matches('path', fv.EXAMPLE_FILE)}", _text("E1", "E2")),
    Rule(
        "concatenated_sql", "code", every_match("F", 6, fv.CONCATENATED_SQL),
        contains_any([".query", ".execute", ".unsafe", ".raw"]), _text("F"),
    ),
    Rule(
        "dynamic_execution", "code", every_match("G", 7, fv.DYNAMIC_EXECUTION),
        contains_any(["eval", "Function"]), _text("G"),
    ),
    Rule("raw_html", "code", _raw_html(), contains_any(["dangerouslySetInnerHTML"]), _text("H")),
)
# Project-level rule: no file of the project is SQL. It reads paths only.
NO_SQL = Rule("no_sql", "project", "NULL", texts=_text("B0"))


def rules_named(*names: str) -> tuple[Rule, ...]:
    known = {r.name: r for r in (*DEFAULT_RULES, NO_SQL)}
    return tuple(known[n] for n in names)


def facts_of_file(rules: Sequence[Rule]) -> Column:
    """``array<FACT>`` of one file; a rule that does not apply costs a comparison or a byte search."""
    found = [
        f"CAST(IF(kind = {literal(r.scope)} AND {r.guard}, {r.find}, NULL) AS array<{FACT}>)" for r in rules
    ]
    return F.expr(f"flatten(array_compact(array({', '.join(found)})))")
