"""Chat formatting with budgeted, turn-aligned windows (DataFrame operations only).

Prefix sums of the turns' token counts cut each conversation into spans of whole turns. A window is a span behind its
context: the leading system turn and as much of the preceding turns as the history budget admits. Only the assistant
turns of the span itself lie under the loss mask, so each is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import sql_text

#: Characters that control strings are made of, and what stands for them inside roles and texts. The first is the escape itself.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"), ("]", "\\e"))
TURN_END = "</s>\n"
#: Tokens that a turn's markup counts as.
MARKUP_TOKENS = 4


def escape_sql(e: str) -> str:
    for raw, code in ESCAPES:
        e = f"replace({e}, {sql_text(raw)}, {sql_text(code)})"
    return e


def unescape_sql(e: str) -> str:
    for raw, code in reversed(ESCAPES):
        e = f"replace({e}, {sql_text(code)}, {sql_text(raw)})"
    return e


def format_conversations(
    turns: DataFrame, budget: int = 1024, history_tokens: int = 192, history_turns: int = 8, system_role: str = "system", target_role: str = "assistant"
) -> DataFrame:
    """Windows of `turns` (conv_id, turn, role, text): conv_id, window, text, n_tokens, n_context, loss.

    A turn is rendered as `[role]\\ntext</s>\\n` with `\\ < [ ]` escaped inside role and text, so no text can forge markup and
    unescaping gives it back. n_context leading turns of a window are repeated context; loss holds the code-point ranges
    (0-based, end exclusive) of the targets in the window's text. Token counts are estimates: words and single marks, plus
    MARKUP_TOKENS a turn. A window exceeds `budget` only if it has a single new turn that is too long by itself.

    Null texts and roles count as empty; rows with a null turn come first; equal turns are ordered by role and text;
    a null conv_id is a conversation of its own; an empty table gives no window. Columns besides the four are ignored.
    """
    fields = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tokens", F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")).cast("long") + MARKUP_TOKENS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    summed = fields.withColumn("idx", F.row_number().over(order)).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = summed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "text", "tokens", "upto"))).alias("turns"))

    has_system = f"(turns[0].role = {sql_text(system_role)})"
    # what a window has for new turns, once the system turn and the history have their share
    room = f"({budget} - {history_tokens} - if({has_system}, turns[0].tokens, 0L))"
    starts = f"""aggregate(turns, named_struct('base', 0L, 'starts', array(1)),
        (acc, t) -> if(t.upto - acc.base > {room} and t.upto - t.tokens > acc.base,
            named_struct('base', t.upto - t.tokens, 'starts', concat(acc.starts, array(t.idx))), acc), acc -> acc.starts)"""
    spans = f"""transform(array({starts}), st -> zip_with(st, concat(slice(st, 2, size(st)), array(size(turns) + 1)), (a, b) -> named_struct('first', a, 'next', b)))[0]"""
    wire = f"concat('[', {escape_sql('t.role')}, ']\\n', {escape_sql('t.text')}, {sql_text(TURN_END).replace(chr(10), chr(92) + 'n')})"
    first, nxt = "s.first", "s.next"
    lowest = f"greatest({first} - {history_turns}, if({has_system}, 2, 1))"
    context = f"""concat(if({has_system} and {first} > 1, slice(turns, 1, 1), slice(turns, 1, 0)),
        filter(slice(turns, {lowest}, greatest({first} - {lowest}, 0)), t -> turns[{first} - 1].upto - turns[{first} - 1].tokens - t.upto + t.tokens <= {history_tokens}))"""
    render = lambda target: f"""t -> named_struct('wire', {wire}, 'head', length({escape_sql('t.role')}) + 3, 'body', length({escape_sql('t.text')}), 'tokens', t.tokens, 'target', {target})"""
    members = f"""concat(transform({context}, {render('false')}),
        transform(slice(turns, {first}, {nxt} - {first}), {render(f't.role = {sql_text(target_role)}')}))"""
    loss = f"""aggregate(m, named_struct('at', 0, 'loss', cast(array() as array<struct<start:int,end:int>>)),
        (acc, x) -> named_struct('at', acc.at + x.head + x.body + {len(TURN_END)},
            'loss', if(x.target, concat(acc.loss, array(named_struct('start', acc.at + x.head, 'end', acc.at + x.head + x.body))), acc.loss)), acc -> acc.loss)"""
    windows = f"""transform({spans}, (s, k) -> transform(array({members}), m -> named_struct('window', k,
        'text', array_join(transform(m, x -> x.wire), ''), 'n_tokens', aggregate(m, 0L, (a, x) -> a + x.tokens),
        'n_context', size(m) - ({nxt} - {first}), 'loss', {loss}))[0])"""
    return grouped.select("conv_id", F.expr(f"inline({windows})"))


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations parsed from the windows' texts alone: conv_id, turns (role, text), loss_text, formatted_chars, n_windows."""
    gathered = windows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "text", "n_context", "loss"))).alias("w"))
    pieces = "flatten(transform(w, x -> transform(array(split(x.text, '</s>\\\\n', -1)), p -> slice(p, x.n_context + 1, size(p) - 1 - x.n_context))[0]))"
    turns = f"""transform({pieces}, p -> named_struct(
        'role', {unescape_sql("substring(p, 2, instr(p, ']') - 2)")}, 'text', {unescape_sql("substring(p, instr(p, ']') + 2)")}))"""
    loss = f"""array_join(flatten(transform(w, x -> transform(x.loss, r -> {unescape_sql('substring(x.text, r.start + 1, r.end - r.start)')}))), '')"""
    return gathered.select(
        "conv_id", F.expr(turns).alias("turns"), F.expr(loss).alias("loss_text"),
        F.expr("aggregate(w, 0L, (a, x) -> a + length(x.text))").alias("formatted_chars"), F.size("w").cast("long").alias("n_windows"),
    )


def digest(windows: DataFrame) -> DataFrame:
    """One row per conversation with what can be read back from its windows."""
    return read_back(windows).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr(r"sha2(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), ''), 256)").alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )
