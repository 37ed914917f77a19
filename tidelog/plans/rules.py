"""Rules: which tables of which database a task follows, and with which select.

A rule names a database and either one table, a list of tables, or a regular expression that is
searched for anywhere in the table's name. The first rule that fits decides; a rule whose filter is
`exclude` drops the table; an empty filter is `select * from` the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.plans.errors import PlanError

EXCLUDE = "exclude"
_SHADOW = r"^_(.+)_(gho|ghc|del)$"


@dataclass(frozen=True)
class Rule:
    dbname: str
    match: str
    filter: str = ""
    target_dbname: str = ""
    tables: tuple[str, ...] = field(init=False)
    pattern: str | None = field(init=False)

    def __post_init__(self) -> None:
        if not self.match:
            raise PlanError("a rule needs a table, a list of tables or /a regular expression/")
        is_pattern = len(self.match) > 1 and self.match[0] == "/" == self.match[-1]
        object.__setattr__(self, "pattern", self.match[1:-1] if is_pattern else None)
        object.__setattr__(self, "tables", () if is_pattern else tuple(t.strip() for t in self.match.split(",") if t.strip()))
        if is_pattern:
            try:
                re.compile(self.match[1:-1])
            except re.error as e:
                raise PlanError(f"bad regular expression {self.match}: {e}") from e

    def fits(self, dbname: str, table: str) -> bool:
        if dbname != self.dbname:
            return False
        return bool(re.search(self.pattern, table)) if self.pattern is not None else table in self.tables

    def select_text(self, table: str) -> str:
        return self.filter or f"select * from `{table}`"


def base_table(table: str) -> str:
    """The table behind an online schema change's shadow: `_t_gho`, `_t_ghc`, `_t_del` and `_t` are t."""
    return re.sub(r"^_(.+)$", r"\1", re.sub(_SHADOW, r"\1", table))


def route(rules: list[Rule], dbname: str, table: str, shadows: bool = False) -> tuple[Rule, str] | None:
    """The first rule that fits and the table it is about; None if there is none or it excludes."""
    names = [table, base_table(table)] if shadows else [table]
    for rule in rules:
        for name in names:
            if rule.fits(dbname, name):
                return None if rule.filter == EXCLUDE else (rule, name)
    return None


def route_column(rules: list[Rule], db: Column, table: Column, shadows: bool = False) -> Column:
    """The number of the deciding rule as a column: null for no rule, -1 for an excluded table."""
    base = F.regexp_replace(F.regexp_replace(table, _SHADOW, "$1"), r"^_(.+)$", "$1") if shadows else table
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        one = lambda name, rule=rule: name.rlike(rule.pattern) if rule.pattern is not None else name.isin(*rule.tables)
        fits = (db == rule.dbname) & (one(table) | one(base))
        out = F.when(fits, F.lit(-1 if rule.filter == EXCLUDE else k)).otherwise(out)
    return out


def ddl_matters(rules: list[Rule], dbname: str, statement: str) -> bool:
    """Whether a DDL statement must be followed: database DDL is not, one that names no table is."""
    m = re.match(r"\s*(create|alter|drop|rename|truncate)\s+(?:(database|schema)\b|(?:table\s+)?(?:if\s+(?:not\s+)?exists\s+)?(.*))", statement, re.I | re.S)
    if not m:
        return True
    if m[2]:
        return False
    names = re.findall(r"(?:`[^`]+`|[\w$]+)(?:\.(?:`[^`]+`|[\w$]+))?", m[3] if m[1].lower() == "rename" else m[3].split("(")[0])
    words = [n.split(".")[-1].strip("`") for n in names if n.lower() not in ("to", "table")]
    wanted = words if m[1].lower() == "rename" else words[:1]
    return not wanted or any(route(rules, dbname, n) for n in wanted)


_DDL = r"(?is)^\s*(create|alter|drop|rename|truncate)\s+(?:(database|schema)\b|(?:table\s+)?(?:if\s+(?:not\s+)?exists\s+)?(.*))"
_NAME = r"(?:`[^`]+`|[\w$]+)(?:\.(?:`[^`]+`|[\w$]+))?"


def ddl_matters_column(rules: list[Rule], db: Column, sql: Column) -> Column:
    """`ddl_matters` over rows of (database, statement)."""
    verb, base, rest = F.lower(F.regexp_extract(sql, _DDL, 1)), F.regexp_extract(sql, _DDL, 2), F.regexp_extract(sql, _DDL, 3)
    names = F.regexp_extract_all(F.when(verb == "rename", rest).otherwise(F.substring_index(rest, "(", 1)), F.lit(f"({_NAME})"), 1)
    plain = F.filter(names, lambda n: ~F.lower(n).isin("to", "table"))
    words = F.transform(plain, lambda n: F.replace(F.element_at(F.split(n, r"\."), -1), F.lit("`"), F.lit("")))
    wanted = F.when(verb == "rename", words).otherwise(F.slice(words, 1, 1))
    followed = F.exists(wanted, lambda n: F.coalesce(route_column(rules, db, n), F.lit(-1)) >= 0)
    return F.when(verb == "", True).when(base != "", False).otherwise((F.size(wanted) == 0) | followed)


def is_hosted_system_statement(sql: Column) -> Column:
    """Statements of hosted servers about their own tables; they are skipped."""
    return sql.contains(" mysql.rds_")


def statement_allowed(rules: list[Rule], dbname: str) -> bool:
    """Whether statements about a database are followed at all."""
    return any(r.dbname == dbname for r in rules)
