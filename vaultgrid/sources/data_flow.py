"""Where cryptographic values of Python sources end: stores, caches, networks, other code, deletion, or nowhere.

A value begins where a name is given the result of a call that makes
cryptography. It follows the control flow of its function: assignments and
containers hand it on, branches join, loops are followed until nothing changes,
code after a return is dead, and a new assignment ends what a name held. Names of
enclosing scopes and attributes of ``self`` hold whatever any statement gave
them. A call that gets the value, or a deletion of a name that holds it, is an
event; the first event in the order of the text decides, as a sink by its
pattern, or as an escape into unknown code that somebody has to review.

Python only reads files, one at a time, behind a cheap gate: it tells values and
their events. Sinks, intent and agility are matched in SQL, sinks once for each
distinct call.

Files that do not parse give one row that asks for review; null content gives
none; a value without events is ephemeral, with medium confidence.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed, rules
from .python_code import dotted

SCHEMA = "path string, variable string, line_no int, line string, parameterised boolean, event string, event_line int, event_seq int, context string"
#: Lines round an event that tell of it.
RADIUS = 5
#: Rounds that a loop, and the names of outer scopes, are followed at most; sets only grow, so chains longer than this in one loop are rare.
MOST = 50

Held = dict[str, frozenset[int]]
NONE: frozenset[int] = frozenset()


def makes(call: ast.Call) -> bool:
    """Whether the called name has a word that makes cryptography."""
    name = called(call).lower()
    return not fixed.MAKERS.isdisjoint(name.replace(".", " ").replace("_", " ").split()) or not fixed.MAKERS.isdisjoint(name.split("."))


def called(node: ast.AST) -> str:
    """A called name as text, calls in the chain included."""
    if isinstance(node, ast.Call):
        return called(node.func)
    if isinstance(node, ast.Attribute):
        return f"{called(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


def join(*states: Held | None) -> Held | None:
    """What names hold after one of several ways; None is a way that does not get there."""
    live = [s for s in states if s is not None]
    if not live:
        return None
    return {name: frozenset().union(*(s.get(name, NONE) for s in live)) for name in set().union(*live)}


class Values:
    """The values of one module and the events that each meets."""

    def __init__(self, tree: ast.Module):
        self.order = {id(node): i for i, node in enumerate(_before(tree))}
        self.made: dict[int, tuple[str, ast.Call]] = {}  # place of the assignment: name, call
        self.events: dict[tuple[int, int], tuple[str, int]] = {}  # (value, place): text, line
        self.outer: dict[tuple[str, str], frozenset[int]] = {}
        self.leaving: list[tuple[list[Held], list[Held]]] = []  # of the loops around: what holds at a break, at a continue
        for _ in range(MOST):
            before = dict(self.outer)
            self.block(tree.body, {}, ("",))
            if self.outer == before:
                break

    # expressions

    def get(self, name: str, state: Held, scopes: tuple[str, ...]) -> frozenset[int]:
        if name in state:
            return state[name]
        for k in range(len(scopes) - 1, 0, -1):
            if ("/".join(scopes[:k]), name) in self.outer:
                return self.outer["/".join(scopes[:k]), name]
        return NONE

    def carried(self, node: ast.AST | None, state: Held, scopes) -> frozenset[int]:
        """The values that an expression hands on; calls in it only meet theirs."""
        if isinstance(node, ast.Name):
            return self.get(node.id, state, scopes)
        if isinstance(node, ast.Attribute):
            own = self.get(dotted(node), state, scopes)
            return own | self.carried(node.value, state, scopes)
        if isinstance(node, ast.Call):
            given = [*node.args, *(k.value for k in node.keywords)]
            for held in [self.carried(a, state, scopes) for a in given]:
                for v in held:
                    self.events.setdefault((v, self.order[id(node)]), (called(node.func), node.lineno))
            held = self.carried(node.func, state, scopes)
            return held if isinstance(node.func, ast.Attribute) else NONE  # a method of a value hands it on; what a function makes of it is its own
        if isinstance(node, ast.NamedExpr):
            self.assign(node.target, node.value, state, scopes, node)
            return self.get(node.target.id, state, scopes)
        if isinstance(node, (ast.Lambda, ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            inner = dict(state)
            for g in getattr(node, "generators", []):
                self.bind(g.target, self.carried(g.iter, inner, scopes), inner, scopes)
                for test in g.ifs:
                    self.carried(test, inner, scopes)
            parts = [node.body] if isinstance(node, ast.Lambda) else [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
            return frozenset().union(*(self.carried(p, inner, scopes) for p in parts))
        if isinstance(node, ast.Compare):
            for child in ast.iter_child_nodes(node):
                self.carried(child, state, scopes)
            return NONE
        if isinstance(node, ast.IfExp):
            self.carried(node.test, state, scopes)
            return self.carried(node.body, state, scopes) | self.carried(node.orelse, state, scopes)
        if isinstance(node, ast.Subscript):
            self.carried(node.slice, state, scopes)
            return self.carried(node.value, state, scopes)
        return frozenset().union(*(self.carried(child, state, scopes) for child in ast.iter_child_nodes(node))) if node is not None else NONE

    # statements

    def bind(self, target: ast.AST, held: frozenset[int], state: Held, scopes) -> None:
        if isinstance(target, ast.Starred):
            target = target.value
        if isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.bind(t, held, state, scopes)
        elif isinstance(target, ast.Subscript):  # the container holds it as well
            name = dotted(target.value)
            if name:
                self.keep(name, held | self.get(name, state, scopes), state, scopes)
        elif name := dotted(target):
            self.keep(name, held, state, scopes)

    def keep(self, name: str, held: frozenset[int], state: Held, scopes) -> None:
        state[name] = held
        if held:
            scope = "/".join(scopes[:-1] if name.startswith("self.") and len(scopes) > 1 else scopes)
            self.outer[scope, name] = self.outer.get((scope, name), NONE) | held

    def assign(self, target: ast.AST, value: ast.AST, state: Held, scopes, at: ast.AST) -> None:
        held = self.carried(value, state, scopes)
        if isinstance(value, ast.Call) and isinstance(target, ast.Name) and makes(value):
            place = self.order[id(at)]
            self.made[place] = (target.id, value)
            held = frozenset((place,))
        if isinstance(target, (ast.Tuple, ast.List)) and isinstance(value, (ast.Tuple, ast.List)) and len(target.elts) == len(value.elts):
            for t, v in zip(target.elts, [self.carried(v, state, scopes) for v in value.elts]):
                self.bind(t, v, state, scopes)
        else:
            self.bind(target, held, state, scopes)

    def block(self, body: list[ast.stmt], state: Held | None, scopes) -> Held | None:
        for node in body:
            if state is None:
                return None
            state = self.statement(node, state, scopes)
        return state

    def loop(self, node, state: Held, scopes) -> Held | None:
        """The body again and again until names hold nothing new; it may run no time at all."""
        for _ in range(MOST):
            entry = dict(state)
            self.leaving.append(([], []))
            if isinstance(node, ast.While):
                self.carried(node.test, entry, scopes)
            else:
                self.bind(node.target, self.carried(node.iter, entry, scopes), entry, scopes)
            ended = self.block(node.body, entry, scopes)
            broken, again = self.leaving.pop()
            after = join(state, ended, *again)
            if after == state:
                break
            state = after
        return join(self.block(node.orelse, dict(state), scopes), *broken)

    def statement(self, node: ast.stmt, state: Held, scopes) -> Held | None:
        if isinstance(node, ast.Assign):
            for target in node.targets:
                self.assign(target, node.value, state, scopes, node)
        elif isinstance(node, ast.AnnAssign):
            if node.value is not None:
                self.assign(node.target, node.value, state, scopes, node)
        elif isinstance(node, ast.AugAssign):
            self.bind(node.target, self.carried(node.value, state, scopes) | self.carried(node.target, state, scopes), state, scopes)
        elif isinstance(node, ast.Delete):
            for target in node.targets:
                name = dotted(target)
                for v in self.get(name, state, scopes) if isinstance(target, ast.Name) else NONE:
                    self.events.setdefault((v, self.order[id(node)]), (f"del {name}", node.lineno))
                if name:
                    state[name] = NONE
        elif isinstance(node, ast.If):
            self.carried(node.test, state, scopes)
            return join(self.block(node.body, dict(state), scopes), self.block(node.orelse, dict(state), scopes))
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            return self.loop(node, state, scopes)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            tried = self.block(node.body, dict(state), scopes)
            caught = [self.block(h.body, join(state, tried) or {}, scopes) for h in node.handlers]
            ended = join(self.block(node.orelse, tried, scopes) if tried is not None else None, *caught)
            if node.finalbody:
                final = self.block(node.finalbody, join(state, tried, ended) or {}, scopes)
                return final if ended is not None else None
            return ended
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                held = self.carried(item.context_expr, state, scopes)
                if item.optional_vars is not None:
                    self.bind(item.optional_vars, held, state, scopes)
            return self.block(node.body, state, scopes)
        elif isinstance(node, ast.Match):
            held = self.carried(node.subject, state, scopes)
            ways: list[Held | None] = [state]
            for case in node.cases:
                inner = dict(state)
                for p in ast.walk(case.pattern):
                    if getattr(p, "name", None):
                        self.keep(p.name, held, inner, scopes)
                ways.append(self.block(case.body, inner, scopes))
            return join(*ways)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for x in [*node.decorator_list, *getattr(getattr(node, "args", None), "defaults", []), *getattr(node, "bases", [])]:
                self.carried(x, state, scopes)
            a = getattr(node, "args", None)
            given = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *(y for y in (a.vararg, a.kwarg) if y)]] if a else []
            loops, self.leaving = self.leaving, []
            self.block(node.body, dict.fromkeys(given, NONE), (*scopes, f"{node.name}:{node.lineno}"))
            self.leaving = loops
        elif isinstance(node, (ast.Return, ast.Raise)):
            for child in ast.iter_child_nodes(node):
                self.carried(child, state, scopes)
            return None
        elif isinstance(node, (ast.Break, ast.Continue)):
            if self.leaving:
                self.leaving[-1][isinstance(node, ast.Continue)].append(state)
            return None
        else:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.expr):
                    self.carried(child, state, scopes)
        return state


def _before(node: ast.AST):
    yield node
    for child in ast.iter_child_nodes(node):
        yield from _before(child)


def scan(source: str) -> list[tuple]:
    """(variable, line, text of the line, parameterised, event, its line, its place, lines round it) of each value and event."""
    lines = source.splitlines()
    found = Values(ast.parse(source))
    met: dict[int, list] = {}
    for (value, place), (text, line) in found.events.items():
        met.setdefault(value, []).append((text, line, place))
    out = []
    for value, (name, call) in sorted(found.made.items()):
        line = lines[call.lineno - 1] if call.lineno <= len(lines) else ""
        parameterised = bool(call.args) and isinstance(call.args[0], (ast.Name, ast.Attribute))
        for text, at, place in met.get(value) or [(None, call.lineno, None)]:
            out.append((name, call.lineno, line, parameterised, text, at, place, "\n".join(lines[max(0, at - RADIUS - 1) : at + RADIUS])))
    return out


_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string()]


def _scanned(batches):
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                rows += [(path, *r) for r in scan(content)]
            except (SyntaxError, ValueError, RecursionError) as e:
                rows.append((path, None, getattr(e, "lineno", None) or 0, None, None, None, None, None, None))
        columns = list(zip(*rows)) if rows else [[]] * len(_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], [x.split()[0] for x in SCHEMA.split(", ")])


def value_events(files: DataFrame) -> DataFrame:
    """A row for each cryptographic value of a file (path, content) and each event that it meets; without events one row."""
    gate = "(?i)" + "|".join(sorted(fixed.MAKERS))
    return files.select("path", "content").where(F.col("content").rlike(gate)).mapInArrow(_scanned, SCHEMA)


def sink_of(call: F.Column) -> F.Column:
    """(tier, confidence, description) of the first group of sinks with a pattern in the call; null if none has."""
    text = F.lower(call)
    groups = [(rules.has_any(text, [p.lower() for p in patterns]), F.struct(F.lit(tier).alias("tier"), F.lit("HIGH").alias("confidence"), F.lit(what).alias("description"))) for tier, what, patterns in fixed.SINKS]
    return F.coalesce(*[F.when(hit, found) for hit, found in groups])


def traced(files: DataFrame) -> DataFrame:
    """One row a value: its tier, how sure, the sink or escape, the evidence, intent and agility."""
    events = value_events(files)
    own = W.partitionBy("path", "variable", "line_no").orderBy(F.col("event_seq").asc_nulls_last())
    first = events.withColumns({"nth": F.row_number().over(own), "events": F.count("event").over(W.partitionBy("path", "variable", "line_no"))}).where("nth = 1")
    broken, gone = F.col("variable").isNull(), F.col("event").startswith("del ")
    sink = F.when(~gone, sink_of(F.col("event")))
    first = first.withColumn("sink", sink)
    escaped = F.col("event").isNotNull() & F.col("sink").isNull() & ~gone
    at = F.col("event_line").cast("string")
    evidence = (
        F.when(broken, "The file does not parse.")
        .when(gone, F.concat(F.lit("Explicit variable destruction ('"), "event", F.lit("') at line "), at, F.lit(".")))
        .when(F.col("sink").isNotNull(), F.concat("sink.description", F.lit(" (Matched sink: '"), "event", F.lit("' at line "), at, F.lit(").")))
        .when(escaped, F.concat(F.lit("Escapes into unanalyzed function '"), "event", F.lit("' at line "), at, F.lit(".")))
        .otherwise(F.concat(F.lit("Created at line "), F.col("line_no").cast("string"), F.lit(", flows into no sink.")))
    )
    reaches = gone | F.col("sink").isNotNull()
    return first.select(
        "path", F.when(broken, "syntax_error").otherwise(F.col("variable")).alias("variable"), "line_no",
        F.when(broken | escaped, "HUMAN_REVIEW").when(F.col("sink").isNotNull(), F.col("sink.tier")).otherwise("EPHEMERAL").alias("tier"),
        F.when(broken | escaped, "LOW").when(reaches, "HIGH").otherwise("MEDIUM").alias("confidence"),
        (broken | F.coalesce(escaped, F.lit(False))).alias("review_required"),
        F.col("event").alias("sink_call"), F.when(F.col("event").isNotNull(), F.col("event_line")).alias("sink_line"), F.col("events").alias("n_events"), evidence.alias("evidence"),
        F.when(broken, "E0_UNCONFIRMED").when(reaches, "E2_REACHABLE_PATH").otherwise("E1_STATIC_ARTIFACT").alias("evidence_level"),
        F.when(broken, "CONFIDENTIALITY_ENVELOPE").otherwise(rules.intent_of(F.col("variable"), F.col("event"), F.col("context"), F.lit(""))).alias("intent_class"),
        F.when(broken, 0).otherwise(rules.agility_of(F.col("line"), F.col("context"), F.lit(""), F.col("parameterised"))).alias("agility_level"),
    )
