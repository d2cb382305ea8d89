"""Chat formatting in budgeted windows, with built-in functions only.

A turn is written as ``<s>[INST]role[/INST]text</s>``. These four control strings are escaped inside
roles and texts by a backslash behind their first character, one more where there are some already, so
that escaping can be undone and no text can open or close a turn.

Prefix sums of the turns' tokens choose the windows: a turn belongs to the window that its first token
falls into, counted from the last turn longer than the history, which has a window of its own. So
windows hold whole turns, and stay within the budget except where a single turn or the system turn is
too long for it. A later window starts with the conversation's system turn, if its first turn is one,
and with as many of the last turns before it as history and budget allow. The loss mask covers the
assistants' texts, but not in turns that a window repeats.

Prefix sums take two steps, within blocks of turn numbers and over the blocks of a conversation, so
that a conversation of any length is dealt over many tasks. Windows meet the turns that they repeat by
an equality join on stretches of `history` tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.skew import spread_join

BUDGET, HISTORY = 2048, 512
#: Numbers of turns in a block.
BLOCK = 256
#: Tokens of a formatted turn; any expression of `piece`, of 1 at least.
TOKENS = "cast(ceil(length(piece) / 4) as long)"

_CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"
_OPEN, _NAMED, _CLOSE = "<s>[INST]", "[/INST]", "</s>"
_KEY = ["ck", "cn"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2")


def _turns(conversations: DataFrame, tokens: str) -> DataFrame:
    """Formatted turns: key (ck, cn), block, sort columns, piece, lead (characters before the text), chars,
    role, tokens."""
    rows = conversations.selectExpr("conv_id", "turn", "coalesce(role, '') role", "coalesce(text, '') text")
    rows = rows.select("conv_id", "turn", "role", "text", escaped(F.col("role")).alias("named"), escaped(F.col("text")).alias("inner"))
    rows = rows.selectExpr(
        "coalesce(conv_id, 0) ck", "conv_id is null cn", f"coalesce(floor(turn / {BLOCK}), -{1 << 60}) block", "turn", "role", "text",
        f"concat('{_OPEN}', named, '{_NAMED}', inner, '{_CLOSE}') piece",
        f"length(named) + {len(_OPEN + _NAMED)} lead", "length(inner) chars",
    )
    return rows.selectExpr("*", f"{tokens} tokens")


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """turns with start (tokens before it in its conversation), at (where its window's stretch begins), system
    (tokens of the system turn), several (whether the conversation may have more than one window)."""
    inside = Window.partitionBy(*_KEY, "block").orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumns({"own": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "place": F.row_number().over(inside)})
    rows = rows.withColumn("ends", F.expr(f"if(tokens > {history}, own + tokens, null)"))
    rows = rows.withColumn("since", F.max("ends").over(before)).drop("text")
    blocks = rows.groupBy(*_KEY, "block").agg(
        F.sum("tokens").alias("total"), F.max("ends").alias("last"),
        F.max(F.expr("if(place = 1 and role = 'system', tokens, 0)")).alias("system"),
    )
    over = Window.partitionBy(*_KEY).orderBy("block")
    earlier, whole = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*_KEY)
    blocks = blocks.withColumn("off", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    blocks = blocks.select(
        *_KEY, "block", "off", F.max(F.expr("off + last")).over(earlier).alias("carry"), F.first("system").over(over).alias("system"),
        F.sum("total").over(whole).alias("all"), F.max("last").over(whole).isNotNull().alias("long"),
    )
    room = f"greatest({budget - history} - system, 1)"
    rows = rows.join(blocks, [*_KEY, "block"]).withColumn("start", F.expr("off + own"))
    base = f"if(tokens > {history}, start, greatest(coalesce(carry, 0), coalesce(off + since, 0)))"
    return rows.selectExpr("*", f"{base} base").selectExpr(
        *_KEY, "start", "role", "piece", "lead", "chars", "tokens", "system",
        f"base + floor((start - base) / {room}) * {room} at", f"long or all > {room} several",
    )


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str = TOKENS) -> DataFrame:
    """(conv_id, at, turns, repeated, tokens, formatted, loss): the windows of all conversations.

    conversations has conv_id, turn, role and text, in any order; other columns are ignored. Turns go by
    turn, a null one first, ties by role and text. Null roles and texts are empty. Rows without a conv_id
    are one conversation. Rows that repeat are turns of their own. at orders the windows of a
    conversation: the token where its stretch begins. The first `repeated` of its turns stand in an
    earlier window too. loss has the stretches [start, end) of formatted, in characters, that count
    for the loss. An empty table gives no windows; a text is never cut, whatever its length. History
    of 0 repeats none.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    placed = _placed(_turns(conversations, tokens), budget, history)
    own = placed.selectExpr(*_KEY, "at", "start", "piece", "lead", "chars", "tokens", "role = 'assistant' target", "false again")
    later = placed.where("several").groupBy(*_KEY, "at").agg(
        F.min("start").alias("first"), F.sum("tokens").alias("fresh"), F.max("system").alias("system")
    ).where("first > 0")
    system = placed.where("start = 0 and role = 'system'").select(*_KEY, "piece", "lead", "chars", "tokens")
    kept = spread_join(later.where("system > 0").select(*_KEY, "at"), system, _KEY)
    again = [kept.selectExpr(*_KEY, "at", "0L start", "piece", "lead", "chars", "tokens", "false target", "true again")]
    if history:
        asking = later.selectExpr(*_KEY, "at", "first", f"least({history}, {budget} - system - fresh) room").where("room > 0")
        near = asking.selectExpr("*", f"explode(array(floor(first / {history}), floor(first / {history}) - 1)) stretch")
        past = placed.where("several and not (start = 0 and role = 'system')")
        past = past.selectExpr(*_KEY, f"floor(start / {history}) stretch", "start", "piece", "lead", "chars", "tokens")
        met = past.join(near, [*_KEY, "stretch"]).where("start < first and first - start <= room")
        again.append(met.selectExpr(*_KEY, "at", "start", "piece", "lead", "chars", "tokens", "false target", "true again"))
    rows = own
    for more in again:
        rows = rows.unionByName(more)
    held = F.sort_array(F.collect_list(F.struct("start", "piece", "lead", "chars", "target", "again")))  # a window's turns
    windows = rows.groupBy(*_KEY, "at").agg(held.alias("held"), F.sum("tokens").alias("tokens"))
    spans = (
        "aggregate(held, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>)), (s, x) -> named_struct("
        "'at', s.at + length(x.piece), 'spans', if(x.target, concat(s.spans, array(named_struct('start', s.at + x.lead, 'end', s.at + x.lead + x.chars))), s.spans))).spans"
    )
    return windows.selectExpr(
        "if(cn, null, ck) conv_id", "at", "size(held) turns", "size(filter(held, x -> x.again)) repeated", "tokens",
        "array_join(transform(held, x -> x.piece), '') formatted", f"{spans} loss",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, at, n, said, loss_text): of each window the number of its turns that no earlier window has, these as
    role, newline, text, newline each, and the text under the loss mask, all unescaped."""
    parts = F.expr(f"slice(split(formatted, '{_CLOSE}'), repeated + 1, turns - repeated)")

    def said(turn: Column) -> Column:
        halves = F.split(turn, r"\[/INST\]")
        return F.concat(unescaped(F.substr(halves[0], F.lit(len(_OPEN) + 1))), F.lit("\n"), unescaped(halves[1]), F.lit("\n"))

    under = F.transform("loss", lambda x: unescaped(F.substr(F.col("formatted"), x["start"] + 1, x["end"] - x["start"])))
    return windows.select(
        "conv_id", "at", F.expr("turns - repeated").alias("n"), F.array_join(F.transform(parts, said), "").alias("said"),
        F.array_join(under, "").alias("loss_text"), F.length("formatted").alias("chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read back from
    its windows. A digest of a conversation needs its text in one row, so it must stay under 2 GB here."""
    held = F.sort_array(F.collect_list(F.struct("at", "said", "loss_text")))
    whole = read_back(windows).groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum(F.col("chars").cast("long")).alias("formatted_chars"), held.alias("held")
    )
    joined = lambda c: f"array_join(transform(held, x -> x.{c}), '')"
    rows = whole.selectExpr("conv_id", "n_turns", "formatted_chars", f"{joined('said')} said", f"{joined('loss_text')} loss_text")
    return rows.selectExpr(
        "conv_id", "cast(n_turns as long) n_turns", "sha2(said, 256) turns_sha256", "cast(length(loss_text) as long) loss_chars",
        "sha2(loss_text, 256) loss_sha256", "formatted_chars",
    )
