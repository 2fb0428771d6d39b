"""Chat formatting chosen by schema fingerprints, in DataFrame functions alone.

A record's layout is the set of field paths that it fills (``messages[].role``, ``prompt``, ...). The sorted paths are
hashed to a fingerprint, and fingerprints select declarative mappings that say how a layout becomes turns (role, text).
Typed columns, structs and arrays of structs are fingerprinted as they are; JSON records are first read with the union of all
layouts' schemas, and what these lack is fingerprinted with its shape. A record whose fingerprint no mapping has keeps null turns and its fingerprint, so that it can be reported.

The template puts a control string before each role and text and after each turn. Control strings of this and of
common other templates inside texts are escaped by a backslash after their first character, one more if there are some
already, which can be undone exactly. The loss mask is a list of (start, length) in code points of the formatted text.

Edge cases: null texts are empty and null roles the empty role; rows of a conversation are ordered by turn, then role, then text
(so repeated turns keep a fixed order); a null conversation id is one conversation; an empty table gives an empty
result; extra columns aren't read. One conversation's output is one row, so it has to fit into memory, as it would in training.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What may follow an opening < or [ in control strings of ours and of other common templates.
_TAILS = r"\||/?s>|/?INST\]|</?SYS>"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*)(?={_TAILS})", rf"([<\[])\\(\\*)(?={_TAILS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


@dataclass(frozen=True)
class Layout:
    """A mapping: ``parts`` are (path, role) in order; or ``turns`` is an array's path with ``role`` and ``text`` fields.

    ``optional`` paths may be filled or not. Paths of parts may join: a tuple of paths is one text, joined by an empty line.
    """

    name: str
    parts: tuple = ()
    turns: str | None = None
    role: str = "role"
    text: str = "text"
    optional: tuple = ()
    roles: dict = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        if self.turns is not None:
            inside = f"{self.turns}[]." if self.turns else ""
            return [inside + self.role, inside + self.text]
        return [p for path, _ in self.parts for p in ([path] if isinstance(path, str) else path)]

    def fingerprints(self) -> list[str]:
        """Of the layout with every choice of its optional paths."""
        sets = [[]]
        for p in self.paths():
            sets = [s + [p] for s in sets] + ([list(s) for s in sets] if p in self.optional else [])
        return [fingerprint(s) for s in sets]


def fingerprint(paths: list[str]) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


_PEOPLE = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
#: The known layouts.
LAYOUTS = (
    Layout("turn rows", turns="", optional=("role", "text")),
    Layout("messages", turns="messages", role="role", text="content", roles=_PEOPLE),
    Layout("messages with text", turns="messages", role="role", text="text", roles=_PEOPLE),
    Layout("from and value", turns="conversations", role="from", text="value", roles=_PEOPLE),
    Layout("prompt and completion", parts=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Layout("prompt and response", parts=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Layout("instruction", parts=((("instruction", "input"), "user"), ("output", "assistant")), optional=("input",)),
    Layout("question and answer", parts=((("context", "question"), "user"), ("answer", "assistant")), optional=("context",)),
    Layout("nested data", parts=(("data.prompt", "user"), ("data.response", "assistant"))),
)


def json_schema(layouts=LAYOUTS) -> T.StructType:
    """Union of the layouts' fields, for reading JSON records."""
    tree: dict = {}
    for layout in layouts:
        for path in layout.paths():
            at = tree
            steps = path.split(".")
            for s in steps[:-1]:
                at = at.setdefault(s, {})
            at[steps[-1]] = None

    def built(node: dict) -> T.StructType:
        kinds = [(k, T.StringType() if v is None else T.ArrayType(built(v)) if k.endswith("[]") else built(v)) for k, v in node.items()]
        return T.StructType([T.StructField(k.removesuffix("[]"), t) for k, t in kinds])

    return built(tree)


def _present(schema: T.StructType, of, prefix: str = "") -> list[tuple[str, Column]]:
    """(path, whether it is filled) of all leaves below a struct; ``of(name)`` is a field's column."""
    out = []
    for f in schema.fields:
        c, kind = of(f.name), f.dataType
        if isinstance(kind, T.StructType):
            out += _present(kind, lambda n, c=c: c[n], f"{prefix}{f.name}.")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for path, _ in _present(kind.elementType, lambda n, c=c: c[n], f"{prefix}{f.name}[]."):
                leaf = path.split("[].", 1)[1] if not prefix else path.removeprefix(f"{prefix}{f.name}[].")
                out.append((path, F.exists(c, _has(leaf))))
        else:
            out.append((prefix + f.name, c.isNotNull()))
    return out


def _has(path: str):
    return lambda e: _field(e, path).isNotNull()


def _field(c: Column, path: str) -> Column:
    for step in path.split("."):
        c = c[step]
    return c


def _unknown(texts: Column, schema: T.StructType, prefix: str = "") -> Column:
    """What JSON objects fill beyond ``schema``: array of (path, shape) lines; scalars of any type have one shape."""
    entries = F.flatten(F.transform(texts, lambda t: F.coalesce(F.map_entries(F.from_json(t, "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))))
    shaped = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")).alias("shape")))

    def extra(e: Column) -> Column:
        known = F.lit(False)
        for f in schema.fields:
            as_read = "OBJECT<.*" if isinstance(f.dataType, T.StructType) else "ARRAY<OBJECT<.*" if isinstance(f.dataType, T.ArrayType) else "(?!OBJECT<|ARRAY<).*"
            known = known | (e["key"] == f.name) & F.regexp_like(e["shape"], F.lit(f"(?s)^{as_read}"))
        return ~known & ~F.regexp_like(e["shape"], F.lit(r"^(?:ARRAY<)*(?:VOID|OBJECT<>)>*$"))

    scalars = r"\b(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\(\d+,\d+\))(?=[,>]|$)"
    out = F.transform(F.filter(shaped, extra), lambda e: F.concat(F.lit(prefix), e["key"], F.lit(" "), F.regexp_replace(e["shape"], scalars, "SCALAR")))
    for f in schema.fields:
        place = f"$['{f.name}']"
        inner = F.transform(texts, lambda t: F.get_json_object(t, place))  # noqa: B023
        if isinstance(f.dataType, T.StructType):
            out = F.concat(out, _unknown(F.array_compact(inner), f.dataType, f"{prefix}{f.name}."))
        elif isinstance(f.dataType, T.ArrayType):
            each = F.flatten(F.array_compact(F.transform(inner, lambda t: F.from_json(t, "array<string>"))))
            out = F.concat(out, _unknown(F.array_compact(each), f.dataType.elementType, f"{prefix}{f.name}[]."))
    return out


def fingerprint_of(schema: T.StructType, of, json: Column | None = None) -> Column:
    """SHA-256 of a row's filled paths, sorted, one a line; ``json``: the record's text, for what ``schema`` lacks."""
    paths = [F.when(has, F.lit(path)) for path, has in sorted(_present(schema, of))]
    if json is not None:
        paths = [F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*paths)), _unknown(F.array_compact(F.array(json)), schema))))]
    return F.sha2(F.concat_ws("\n", *paths).cast("binary"), 256)


_TURNS = "array<struct<role:string,text:string>>"


def _mapped(layout: Layout, schema: T.StructType, of) -> Column | None:
    """The layout's turns, or None if the schema lacks one of its fields."""
    known = {p for p, _ in _present(schema, of)}
    if not set(layout.paths()) - set(layout.optional) <= known:
        return None

    def at(path: str) -> Column:
        head, *rest = path.split(".")
        return _field(of(head), ".".join(rest)) if rest else of(head)

    def role(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        for a, b in layout.roles.items():
            c = F.when(F.lower(c) == a, F.lit(b)).otherwise(c)
        return c.alias("role")

    if layout.turns == "":
        fields = [at(p) if p in known else F.lit(None).cast("string") for p in layout.paths()]
        return F.array(F.struct(role(fields[0]), F.coalesce(fields[1], F.lit("")).alias("text")))
    if layout.turns is not None:
        return F.transform(at(layout.turns), lambda e: F.struct(role(_field(e, layout.role)), F.coalesce(_field(e, layout.text), F.lit("")).alias("text")))
    turns = []
    for path, who in layout.parts:
        paths = [p for p in ([path] if isinstance(path, str) else path) if p in known]
        if paths:
            turns.append(F.when(F.coalesce(*(at(p) for p in paths)).isNotNull(), F.struct(F.lit(who).alias("role"), F.concat_ws("\n\n", *(at(p) for p in paths)).alias("text"))))
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def canonical(df: DataFrame, columns: list[str] | None = None, json: str | None = None, layouts=LAYOUTS) -> DataFrame:
    """``df`` with fingerprint, layout (null: none known) and turns: array of (role, text).

    ``columns``: those that make up the record (all by default); ``json``: a string column that holds the records instead. A column of
    ``df`` that has one of these names stays as it is; the new one then gets an underscore at its end.
    """
    names = {n: fresh(n, df.columns) for n in ("fingerprint", "layout", "turns")}
    if json is not None:
        record = fresh("_record", df.columns)
        schema = json_schema(layouts)
        df = df.withColumn(record, F.from_json(F.col(json), schema))
        of = lambda n: F.col(record)[n]
    else:
        schema, record = T.StructType([df.schema[c] for c in columns or df.columns]), None
        of = lambda n: F.col(f"`{n}`")
    mark = fresh("_fingerprint", df.columns)
    df = df.withColumn(mark, fingerprint_of(schema, of, None if json is None else F.col(json)))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for layout in layouts:
        if (made := _mapped(layout, schema, of)) is not None:
            here = F.col(mark).isin(*(f for f in layout.fingerprints() if json is None or f != fingerprint([])))
            name, turns = F.when(here, F.lit(layout.name)).otherwise(name), F.when(here, made.cast(_TURNS)).otherwise(turns)
    out = df.withColumns({names["layout"]: name, names["turns"]: turns}).withColumnRenamed(mark, names["fingerprint"])
    return out.drop(record) if record else out


def format_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) from rows (conv_id, turn, role, text): one text for each conversation and its loss mask."""
    turns = canonical(rows.select("conv_id", "turn", "role", "text"), ["role", "text"])
    turns = turns.select("conv_id", "turn", F.inline("turns"))
    head, body = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)), escape(F.col("text"))
    parts = turns.select("conv_id", "turn", "role", "text", F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("lead"), F.length(body).alias("size"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumns({"n": F.row_number().over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "upto": F.sum(F.length("piece")).over(order)})
    span = F.struct((F.col("upto") - F.length("piece") + F.col("lead")).cast("long").alias("start"), F.col("size").cast("long").alias("length"))
    all_turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", F.when(F.col("role") == "assistant", span).alias("span")))).alias("all"))
    return all_turns.select("conv_id", F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"), F.filter(F.transform("all", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring(p, F.locate(TEXT, p) + len(TEXT), F.length(p)), END, 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """What the mask covers, unescaped, joined by nothing."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
