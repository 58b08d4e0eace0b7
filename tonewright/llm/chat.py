"""Chat formatting with tool calls linked to their results. DataFrame operations only.

Results are hash-joined to calls by identifier, the calls being counted first: beyond HASHED for
each shuffle partition a hash table might not fit, and Spark sorts both sides instead. Messages are
put in topological order: a call stands at its own turn or, if it waits for another call, after
that one's result; a result stands after its call whatever its turn. Arguments are checked against the schema of
the tool by name: required and known fields, types, bounds. Every message becomes one line of
canonical JSON: sorted keys at every depth, no spaces. What isn't a call is valid.

Cases: a result without a call is an ``orphan`` and stays at its turn; a call without a result
is not linked; of calls that share an identifier the first (by turn, then arguments) is linked
to; arguments that aren't a JSON object, and tools without a schema, are invalid; calls that
wait in a circle or for one, stand at their own turn, and a call that isn't there is not waited for; null text is null
in the line; rows without a conversation or turn are kept, those without a turn first; repeated
rows are kept, and so are very long texts, whole; what ties in turn and kind goes by its line; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Tools of the query: field, type, required, least and most (length of strings, value of numbers).
SCHEMAS = {"reply": [("text", "string", True, 1, 1000), ("turn", "integer", True, 0, None)]}
HASHED = 1_000_000  # calls of a shuffle partition that are joined by hash
TURNS = 64  # of a conversation in one range of its order
_KIND = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def valid(name: Column, arguments: Column, schemas: dict) -> Column:
    """Whether the JSON text in ``arguments`` fits the schema of the tool."""
    read = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, fields in sorted(schemas.items()):
        ok = F.coalesce(F.schema_of_variant(read).startswith("OBJECT<"), F.lit(False))
        ok &= F.coalesce(F.size(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f[0]) for f in fields]))) == 0, F.lit(False))
        for field, kind, required, least, most in fields:
            value = F.try_variant_get(read, f"$.{field}", "variant")
            absent = value.isNull()
            if kind == "number":
                fits = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL)")
            else:
                fits = F.schema_of_variant(value) == _KIND[kind]
            size = F.length(F.try_variant_get(read, f"$.{field}", "string")) if kind == "string" else F.try_variant_get(read, f"$.{field}", "double")
            if least is not None:
                fits &= size >= least
            if most is not None:
                fits &= size <= most
            ok &= F.when(absent, F.lit(not required)).otherwise(F.coalesce(fits, F.lit(False)))
        out = F.when(name == tool, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no spaces; text that isn't JSON becomes a JSON string."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), F.to_json(json.cast("variant")), F.lit("null"))


def depths(calls: DataFrame) -> DataFrame:
    """calls(conv_id, call_id, turn, done, after) -> conv_id, call_id, base, depth of those that wait for
    others, all of which are there: base the last turn of the calls it waits for, through others, and of
    their results (``done``); depth how many there are on the longest way.

    Each round settles the calls that wait for settled ones only, and lets those that wait for a call
    with a single wait of its own look past it, so chains halve in a round."""
    key = ["conv_id", "call_id"]
    listed = F.coalesce(F.when(F.col("after").startswith("["), F.from_json("after", "array<string>")), F.array("after"))
    there = calls.select("conv_id", F.col("call_id").alias("next"), F.col("done").alias("base"))
    # A way to wait: what is known of the calls on it (base, depth), and the call that it goes on from (next).
    ways = calls.where("after is not null").select(*key, F.explode(F.array_distinct(listed)).alias("next")).join(there, ["conv_id", "next"]).select(*key, "next", "base", F.lit(1).cast("long").alias("depth"))
    own = ["conv_id", F.col("call_id").alias("next")]
    waiting = ways.select(*own).distinct().withColumn("open", F.lit(True))
    best = [F.max("base").alias("base"), F.max("depth").alias("depth")]
    now = common.settle(ways.join(waiting, ["conv_id", "next"], "left").select(*key, F.when(F.col("open"), F.col("next")).alias("next"), "base", "depth").groupBy(*key, "next").agg(*best), "waits")
    before = None
    while True:
        # Calls by what is left: those with no way that goes on are settled.
        state = now.groupBy(*key).agg(F.count("next").alias("left"), F.max(F.when(F.col("next").isNull(), F.struct("base", "depth"))).alias("_closed"), F.max("base").alias("base"), F.max("depth").alias("depth"), F.max("next").alias("only"))
        unsettled = state.where("left > 0").count()
        if not unsettled or unsettled == before:  # what is left waits in a circle, or for one
            return state.where("left = 0").select(*key, "base", "depth")
        before = unsettled
        far = state.where("left <= 1").select(*own, F.col("left"), F.col("base").alias("_base"), F.col("only"))
        ends = now.where("next is null").select(*own, F.col("depth").alias("_done_depth"))
        goes = now.where("next is not null").select(*own, F.col("depth").alias("_way"))
        # For one that waits on a single way: the depth on it, and that of what is settled beside it.
        far = far.join(ends, ["conv_id", "next"], "left").join(goes, ["conv_id", "next"], "left")
        open_ways = now.where("next is not null").join(far, ["conv_id", "next"], "left")
        base = F.greatest("base", "_base")
        stay = open_ways.where("left is null").select(*key, "next", "base", "depth")
        settled = open_ways.where("left is not null and _done_depth is not null").select(*key, F.lit(None).cast("string").alias("next"), base.alias("base"), (F.col("depth") + F.col("_done_depth")).alias("depth"))
        on = open_ways.where("left = 1").select(*key, F.col("only").alias("next"), base.alias("base"), (F.col("depth") + F.col("_way")).alias("depth"))
        done = now.where("next is null").select(*key, "next", "base", "depth")
        now = common.settle(stay.unionByName(settled).unionByName(on).unionByName(done).groupBy(*key, "next").agg(*best), "waits")


def link(messages: DataFrame, schemas: dict) -> DataFrame:
    """messages(conv_id, turn, role, kind, call_id, name, arguments, after, text, other), kind ``call``,
    ``result`` or ``message``, after the id of a call that a call waits for or a JSON list of such, other
    a JSON object of what else a turn holds, or null -> conv_id, position, turn, role, kind, call_id,
    linked, valid, line."""
    if "other" not in messages.columns:
        messages = messages.withColumn("other", F.lit(None).cast("string"))
    first = messages.where("kind = 'call' and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "arguments", "after")).alias("call")).select("conv_id", "call_id", F.col("call.turn").alias("call_turn"), F.col("call.after").alias("after"))
    answered = messages.where("kind = 'result' and call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.max("turn").alias("result_turn"))
    first = common.settle(first, "calls")
    fits = first.count() <= HASHED * int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = lambda df: df.hint("shuffle_hash") if fits else df
    known = hashed(first).join(answered, ["conv_id", "call_id"], "left")
    if not first.where("after is not null").isEmpty():
        known = known.join(depths(known.select("conv_id", "call_id", F.col("call_turn").alias("turn"), F.greatest("call_turn", "result_turn").alias("done"), "after")), ["conv_id", "call_id"], "left").withColumns({"at": F.coalesce(F.greatest("call_turn", "base"), "call_turn"), "depth": F.coalesce("depth", F.lit(0))})
    else:
        known = known.withColumns({"at": F.col("call_turn"), "depth": F.lit(0)})
    known = known.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "at", "depth", "n_results")
    joined = messages.join(hashed(known), F.expr("conv_id <=> _c AND call_id = _i"), "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    linked = F.when(is_call, F.coalesce(F.col("n_results") > 0, F.lit(False))).when(is_result, F.col("at").isNotNull()).otherwise(F.lit(False))
    told = joined.withColumns({
        "linked": linked,
        "valid": ~is_call | valid(F.col("name"), F.col("arguments"), schemas),
        "kind": F.when(is_result & F.col("at").isNull(), "orphan").otherwise(F.col("kind")),
        "anchor": F.when(is_call & F.col("at").isNotNull(), F.greatest("turn", "at")).when(is_result & F.col("at").isNotNull(), F.greatest("turn", "at")).otherwise(F.col("turn")),
        "level": F.when(is_call, 2 * F.coalesce("depth", F.lit(0))).when(is_result, 2 * F.coalesce("depth", F.lit(0)) + 1).otherwise(0),
    })
    body = F.concat(
        F.when(is_call, F.concat(F.lit('"arguments":'), canonical(F.col("arguments")), F.lit(","))).otherwise(F.lit("")),
        F.when(is_call, F.lit("")).otherwise(F.concat(F.lit('"content":'), F.coalesce(F.to_json(F.col("text").cast("variant")), F.lit("null")), F.lit(","))),
        F.when(F.col("call_id").isNotNull(), F.concat(F.lit('"id":'), F.to_json(F.col("call_id").cast("variant")), F.lit(","))).otherwise(F.lit("")),
        F.lit('"kind":"'), F.col("kind"), F.lit('"'),
        F.when(is_call, F.concat(F.lit(',"name":'), F.coalesce(F.to_json(F.col("name").cast("variant")), F.lit("null")))).otherwise(F.lit("")),
        F.when(F.col("other").isNotNull(), F.concat(F.lit(',"other":'), canonical(F.col("other")))).otherwise(F.lit("")),
        F.lit(',"role":'), F.coalesce(F.to_json(F.col("role").cast("variant")), F.lit("null")),
        F.when(is_call, F.concat(F.lit(',"valid":'), F.col("valid").cast("string"))).otherwise(F.lit("")),
    )
    told = told.withColumn("line", F.concat(F.lit("{"), body, F.lit("}"))).withColumn("range", F.floor(F.coalesce("anchor", F.lit(-1)) / TURNS))
    told = told.select("conv_id", "turn", "role", "kind", "call_id", "linked", "valid", "anchor", "level", "range", "line")
    # Positions: within ranges of turns, then over them, so a long conversation is dealt out.
    counts = told.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = counts.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("anchor").asc_nulls_first(), "level", F.col("turn").asc_nulls_first(), "line")
    return told.withColumn("row", F.row_number().over(inside)).join(before, F.expr("conv_id <=> _c AND range = _r")).select("conv_id", (F.col("before") + F.col("row")).cast("long").alias("position"), "turn", "role", "kind", "call_id", "linked", "valid", "line")


def from_turns(conversations: DataFrame) -> DataFrame:
    """Events of a plain conversation: a user's turn calls the tool ``reply`` with its text, an
    assistant's turn is the result of the turn before it; other roles are messages. Turns whose
    text is JSON with ``tool_calls`` (a list of objects, one at least) or ``tool_call_id`` are read
    as that; content beside calls, and other keys of the turn, are a message of the same turn. A call's
    name and arguments are its own or those of its ``function``; ``after`` is an id or a list of ids."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    asked = F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string"))
    told = F.from_json(F.when(F.col("text").startswith("{"), F.get_json_object("text", "$.tool_calls")), "array<struct<id:string,name:string,arguments:string,after:string,function:struct<name:string,arguments:string>>>")
    kinds = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.when(F.col("text").startswith("{"), F.col("text"))), "$.tool_calls", "variant"))
    rows = rows.withColumn("_calls", F.when(kinds.startswith("ARRAY<OBJECT<") & (F.size(told) > 0), told))
    answer = F.when(F.col("text").startswith("{"), F.get_json_object("text", "$.tool_call_id"))
    plain = rows.where("_calls is null").withColumn("_answer", answer).select(
        "conv_id", "turn", "role",
        F.when(F.col("_answer").isNotNull(), "result").when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message").alias("kind"),
        F.coalesce("_answer", F.when(F.col("role") == "user", name).when(F.col("role") == "assistant", asked)).alias("call_id"),
        F.when((F.col("role") == "user") & F.col("_answer").isNull(), "reply").alias("name"),
        F.when((F.col("role") == "user") & F.col("_answer").isNull(), F.to_json(F.struct("text", "turn"))).alias("arguments"),
        F.lit(None).cast("string").alias("after"), "text",
    )
    calls = rows.where("_calls is not null").select("conv_id", "turn", "role", F.explode("_calls").alias("c"), "text")
    calls = calls.select("conv_id", "turn", "role", F.lit("call").alias("kind"), F.col("c.id").alias("call_id"), F.coalesce("c.name", "c.function.name").alias("name"), F.coalesce("c.arguments", "c.function.arguments").alias("arguments"), F.col("c.after").alias("after"), "text")
    more = F.map_filter(F.from_json("text", "map<string,variant>"), lambda k, _: ~k.isin("tool_calls", "content", "role"))
    beside = rows.where("_calls is not null").withColumn("other", F.when(F.size(more) > 0, F.to_json(more))).withColumn("text", F.get_json_object("text", "$.content")).where("text is not null or other is not null")
    beside = beside.select("conv_id", "turn", "role", F.lit("message").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("call_id", "name", "arguments", "after")], "text", "other")
    return plain.unionByName(calls).unionByName(beside, allowMissingColumns=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(from_turns(common.table(spark, sf_dir, "conversations")), SCHEMAS)


ORACLE = """
WITH m AS (SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN concat(conv_id, ':', turn) WHEN 'assistant' THEN concat(conv_id, ':', turn - 1) END AS call_id FROM conversations),
c AS (SELECT conv_id, call_id, min(turn) AS call_turn FROM m WHERE kind = 'call' GROUP BY ALL),
a AS (SELECT conv_id, call_id, count(*) AS n FROM m WHERE kind = 'result' GROUP BY ALL),
j AS (SELECT m.*, c.call_turn, CASE WHEN m.kind = 'call' THEN a.n IS NOT NULL WHEN m.kind = 'result' THEN c.call_turn IS NOT NULL ELSE false END AS linked,
    m.kind <> 'call' OR (coalesce(length(m.text) BETWEEN 1 AND 1000, false) AND m.turn IS NOT NULL) AS valid
  FROM m LEFT JOIN c USING (conv_id, call_id) LEFT JOIN a USING (conv_id, call_id)),
k AS (SELECT conv_id, turn, role, CASE WHEN kind = 'result' AND call_turn IS NULL THEN 'orphan' ELSE kind END AS kind, call_id, linked, valid,
    greatest(turn, CASE WHEN kind <> 'message' THEN coalesce(call_turn, turn) ELSE turn END) AS anchor, CASE WHEN kind = 'result' THEN 1 ELSE 0 END AS level, text FROM j),
l AS (SELECT *, CASE WHEN kind = 'call' THEN concat('{"arguments":{"text":', to_json(text), ',"turn":', turn, '},"id":"', call_id, '","kind":"call","name":"reply","role":"user","valid":', valid, '}')
    ELSE concat('{"content":', to_json(text), ',', CASE WHEN call_id IS NOT NULL THEN concat('"id":"', call_id, '",') ELSE '' END, '"kind":"', kind, '","role":"', role, '"}') END AS line FROM k)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY anchor NULLS FIRST, level, turn NULLS FIRST, line) AS position, turn, role, kind, call_id, linked, valid, line FROM l
"""
