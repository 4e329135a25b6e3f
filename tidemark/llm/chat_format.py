"""Chat formatting: tool calls linked with their results, ordered, validated, as canonical JSON.

Method: calls and results are hash-joined by (conversation, identifier); calls are put in
topological order of the results that they depend on; arguments are checked against schemas that are compiled into column expressions; every
message becomes one line of canonical JSON (sorted keys, no white space).

Calls come from ``<tool_call>{...}</tool_call>`` in the messages of assistants (a JSON
object with ``id``, ``name``, ``arguments`` and optionally ``depends_on``), results from
``<tool_result>{...}</tool_result>`` in messages of the role ``tool`` (``id``,
``content``).  Besides, every user turn counts as a call of ``reply`` whose identifier is its
turn, and an assistant's next turn, if it holds no call, as its result.

Scale: rows stay messages; nothing is collected per conversation, so that a conversation
with a third of all rows is only a set of rows of its own.  Joins are by (conversation,
identifier), which AQE may split.  Chains of calls that depend on one call each are ordered
by pointer doubling, in a logarithmic number of rounds; only calls that wait for several
take a round for each level of such calls.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import removed, stored, written

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_result>(.*?)</tool_result>"
CALL_SCHEMA = "id string, name string, arguments string, depends_on array<string>"
RESULT_SCHEMA = "id string, content string"
#: Arguments of each tool: name -> (kind, required); kinds are those of ``KINDS``.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {"reply": {"prompt": ("string", True)}}
#: Patterns of Spark's variant type names.
KINDS = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
}
ID = ["conv_id", "id"]
#: The error of markup that holds no JSON object.
BROKEN = "broken markup"


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with null texts as empty ones; repeated rows once."""
    return conversations.select(
        "conv_id", "turn", F.lower(F.coalesce("role", F.lit(""))).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()


def parsed(chat: DataFrame, role: str, markup: str, schema: str) -> DataFrame:
    """(conv_id, turn, part, raw, j): the JSON objects of a markup, null where it is broken."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(markup), 1)).alias("part", "raw")
    own = chat.where((F.col("role") == role) & F.col("text").rlike(markup)).select("conv_id", "turn", found)
    return own.withColumn("j", F.from_json("raw", schema))


def broken() -> Column:
    """The raw string of ``parsed`` markup that is no JSON object."""
    no_object = ~F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).rlike(KINDS["object"]), F.lit(False))
    return F.when(no_object, F.col("raw")).alias("broken")


def calls(chat: DataFrame) -> DataFrame:
    """(conv_id, id, turn, part, name, arguments, depends_on, broken), marked and plain ones.

    ``broken`` is the raw string of markup that is no JSON object, else null.
    """
    marked = parsed(chat, "assistant", CALL, CALL_SCHEMA).select(
        "conv_id", F.col("j.id").alias("id"), "turn", "part", F.col("j.name").alias("name"),
        F.coalesce("j.arguments", F.lit("{}")).alias("arguments"), F.col("j.depends_on").alias("depends_on"), broken(),
    )
    plain = chat.where("role = 'user'").select(
        "conv_id", F.concat(F.lit("turn:"), F.col("turn").cast("string")).alias("id"), "turn", F.lit(0).alias("part"),
        F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"),
        F.lit(None).cast("array<string>").alias("depends_on"), F.lit(None).cast("string").alias("broken"),
    )
    return marked.unionByName(plain)


def results(chat: DataFrame) -> DataFrame:
    """(conv_id, id, turn, part, content, broken); a plain one has the identifier of the turn before."""
    marked = parsed(chat, "tool", RESULT, RESULT_SCHEMA).select(
        "conv_id", F.col("j.id").alias("id"), "turn", "part", F.coalesce("j.content", F.lit("")).alias("content"), broken()
    )
    plain = chat.where((F.col("role") == "assistant") & ~F.col("text").rlike(CALL)).select(
        "conv_id", F.concat(F.lit("turn:"), (F.col("turn") - 1).cast("string")).alias("id"), "turn",
        F.lit(0).alias("part"), F.col("text").alias("content"), F.lit(None).cast("string").alias("broken"),
    )
    return marked.unionByName(plain)


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments; the schemas become one expression."""
    value = F.try_parse_json(arguments)
    keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
    found = [F.when(value.isNull() | keys.isNull(), F.lit("not an object"))]
    known = F.lit(False)
    for tool, fields in schemas.items():
        mine = name == tool
        known = known | mine
        extra = F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>"))
        found.append(F.when(mine & (F.size(extra) > 0), F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ","))))
        for field, (kind, required) in fields.items():
            part = F.try_variant_get(value, f"$['{field}']", "variant")
            there = F.array_contains(keys, field)
            if required:
                found.append(F.when(mine & ~there, F.lit(f"missing: {field}")))
            found.append(F.when(mine & there & ~F.schema_of_variant(part).rlike(KINDS[kind]), F.lit(f"not {kind}: {field}")))
    found.append(F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown tool")))
    return F.array_compact(F.array(*found))


def raw_json(kind: str) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("broken").alias("raw")))


def jumped(single: DataFrame) -> DataFrame:
    """(conv_id, id, up, far): where chains of calls with one dependency (conv_id, id, up) end, and how far off.

    Chains on a cycle keep an end that has a dependency itself.
    """
    now, path = stored(single.withColumn("far", F.lit(1).cast("long")), "chat-chains")
    rounds = max(now.count(), 1).bit_length() + 1
    for _ in range(rounds):
        more = now.select("conv_id", F.col("id").alias("up"), F.col("up").alias("next"), F.col("far").alias("step"))
        joined = now.join(more, ["conv_id", "up"], "left")
        last = path
        now, path = stored(joined.select(*ID, F.coalesce("next", "up").alias("up"), (F.col("far") + F.coalesce("step", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")), "chat-chains")
        removed(now.sparkSession, last)
        moved = not now.where("moved").isEmpty()
        now = now.drop("moved")
        if not moved:
            break
    return now


def levels(own: DataFrame) -> DataFrame:
    """(conv_id, id, level): 0 without dependencies, else one more than the last of them.

    Calls on a cycle, or behind one, get a null level, and dependencies on calls that do
    not exist count as met.
    """
    nodes = own.select(*ID).distinct()
    edges = (
        own.select(*ID, F.explode("depends_on").alias("d"))
        .distinct()
        .join(nodes.select(F.col("conv_id").alias("c"), F.col("id").alias("n")), (F.col("conv_id") == F.col("c")) & (F.col("d") == F.col("n")))
        .select(*ID, "d")
    )
    edges = written(edges, "chat-edges")
    if edges.isEmpty():
        return nodes.withColumn("level", F.lit(0))
    spark = edges.sparkSession
    waits = edges.groupBy(*ID).agg(F.count("*").alias("n"), F.min("d").alias("up"))
    chains = jumped(waits.where("n = 1").select(*ID, "up"))
    # what each dependency of the others comes down to: a call that is no link of a chain
    many = edges.join(waits.where("n > 1").select(*ID), ID, "left_semi")
    ends = chains.select("conv_id", F.col("id").alias("d"), "up", "far")
    many = written(many.join(ends, ["conv_id", "d"], "left").select(*ID, F.coalesce("up", "d").alias("up"), F.coalesce("far", F.lit(0).cast("long")).alias("far")), "chat-merges")
    done, path = stored(nodes.join(waits.select(*ID), ID, "left_anti").withColumn("level", F.lit(0).cast("long")), "chat-levels")
    paths, schema = [path], done.schema
    while not many.isEmpty():
        ready = (
            many.join(done.select("conv_id", F.col("id").alias("up"), "level"), ["conv_id", "up"], "left")
            .groupBy(*ID)
            .agg(F.count_if(F.col("level").isNull()).alias("open"), (F.max(F.col("level") + F.col("far")) + 1).alias("level"))
            .where("open = 0")
            .select(*ID, "level")
            .join(done, ID, "left_anti")
        )
        new, path = stored(ready, "chat-levels")
        if new.isEmpty():
            break
        paths.append(path)
        done = spark.read.schema(schema).parquet(*paths)
    at_end = done.select("conv_id", F.col("id").alias("up"), F.col("level").alias("base"))
    linked = chains.join(at_end, ["conv_id", "up"]).select(*ID, (F.col("base") + F.col("far")).cast("int").alias("level"))
    return nodes.join(done.select(*ID, F.col("level").cast("int").alias("level")).unionByName(linked), ID, "left")


def formatted(
    conversations: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None
) -> DataFrame:
    """(conv_id, turn, part, kind, call_id, status, level, errors, json) for calls, results, others.

    ``kind`` is call, result or message.  ``status`` of a call is answered, unanswered or
    duplicate (an identifier that an earlier call of the conversation has); of a result
    linked, early (it stands before its call) or orphan.  ``level`` is the topological
    position: a result stands one behind its call.  ``errors`` lists what is wrong with
    arguments; invalid calls stay.  Broken markup is a call or result without identifier, with
    an error and its raw string in ``json``.  Text around markup is a message of its turn, the
    markup cut out of it.
    Null ids of conversations or turns never link.  Repeated rows count once.
    """
    chat = messages(conversations)
    own, replies = calls(chat), results(chat)
    first = own.groupBy(*ID).agg(F.min(F.struct("turn", "part")).alias("first"))
    answers = replies.groupBy(*ID).agg(F.count("*").alias("n"))
    order = levels(own)
    asked = (
        own.join(first, ID, "left")
        .join(answers, ID, "left")
        .join(order, ID, "left")
        .select(
            "conv_id", "turn", "part", F.lit("call").alias("kind"), F.col("id").alias("call_id"),
            F.when(F.struct("turn", "part") != F.col("first"), "duplicate")
            .when(F.col("n") > 0, "answered").otherwise("unanswered").alias("status"),
            "level",
            F.when(F.col("broken").isNotNull(), F.lit(BROKEN))
            .otherwise(F.array_join(problems(F.col("name"), F.col("arguments"), schemas or SCHEMAS), "; ")).alias("errors"),
            F.when(F.col("broken").isNotNull(), raw_json("call")).otherwise(F.to_json(F.struct(
                F.try_parse_json("arguments").alias("arguments"), F.col("id"), F.lit("call").alias("kind"), F.col("name"),
            ))).alias("json"),
        )
    )
    answered = replies.join(first, ID, "left").join(order, ID, "left").select(
        "conv_id", "turn", "part", F.lit("result").alias("kind"), F.col("id").alias("call_id"),
        F.when(F.col("first").isNull(), "orphan").when(F.col("turn") < F.col("first.turn"), "early").otherwise("linked").alias("status"),
        (F.col("level") + 1).alias("level"),
        F.when(F.col("broken").isNotNull(), F.lit(BROKEN)).otherwise(F.lit("")).alias("errors"),
        F.when(F.col("broken").isNotNull(), raw_json("result"))
        .otherwise(F.to_json(F.struct(F.col("content"), F.col("id"), F.lit("result").alias("kind")))).alias("json"),
    )
    around = [
        chat.where((F.col("role") == role) & F.col("text").rlike(markup))
        .withColumn("text", F.regexp_replace("text", markup, ""))
        .where(F.col("text").rlike(r"\S"))
        for role, markup in (("assistant", CALL), ("tool", RESULT))
    ]
    plain = chat.where(~F.col("role").isin("user", "assistant", "tool") | (F.col("role") == "tool") & ~F.col("text").rlike(RESULT))
    rest = plain.unionByName(around[0]).unionByName(around[1]).select(
        "conv_id", "turn", F.lit(0).alias("part"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("level"), F.lit("").alias("errors"),
        F.to_json(F.struct(F.col("text").alias("content"), F.lit("message").alias("kind"), F.col("role"))).alias("json"),
    )
    return asked.unionByName(answered).unionByName(rest)


#: Schemas of the calls of ``with_tools``.
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {**SCHEMAS, "lookup": {"n": ("integer", True), "q": ("string", True)}}


def with_tools(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with tool calls, for a table that has none.

    ``r``, which is 0 to 9 by conversation and turn, decides on each turn of an assistant.
    Below 3 it stays as it is; else its text gets a call of ``lookup``, most of them with a
    dependency on the call two turns before, and a tool answers in the same turn.  3 repeats
    an identifier, 4 names an unknown tool that never answers, 5 to 7 have arguments that
    break the schema, 6 is answered for another identifier and 7 not at all, 9 depends on
    itself.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    r = F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(10))
    asks = (F.lower("role") == "assistant") & (r >= 3)
    name = lambda k: F.concat(F.lit("c"), (F.col("turn") - k).cast("string"))
    own = F.when(r == 3, name(2)).otherwise(name(0))
    query = F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8)
    n = F.col("turn")
    arguments = (
        F.when(r == 5, F.to_json(F.struct(F.lit("x").alias("n"))))
        .when(r == 6, F.to_json(F.struct(F.lit(1).alias("z"), n.alias("n"), query.alias("q"))))
        .when(r == 7, F.to_json(F.struct(n.alias("n"))))
        .otherwise(F.to_json(F.struct(n.alias("n"), query.alias("q"))))
    )
    tool = F.when(r == 4, "nope").otherwise("lookup")
    needs = F.when(r.between(4, 8), F.to_json(F.array(name(2)))).when(r == 9, F.to_json(F.array(name(0)))).otherwise("[]")
    call = F.format_string('<tool_call>{"id":"%s","name":"%s","arguments":%s,"depends_on":%s}</tool_call>', own, tool, arguments, needs)
    reply = F.format_string('<tool_result>{"id":"%s","content":"found %s"}</tool_result>', F.when(r == 6, "zz").otherwise(own), n)
    asked = rows.withColumn("text", F.when(asks, F.concat(F.coalesce("text", F.lit("")), call)).otherwise(F.col("text")))
    answers = rows.where(asks & ~r.isin(4, 7)).select("conv_id", "turn", F.lit("tool").alias("role"), reply.alias("text"))
    return asked.unionByName(answers)
