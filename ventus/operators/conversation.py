"""Messages and conversations in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 12

# Wordings that begin a conversation anew.
RESET_ALONE = r"(?i)^reset[.!?]*$"
RESET_PHRASE = r"(?i)\b(?:reset|clear|restart|start over|new)\s+(?:this\s+)?(?:conversation|chat|context)\b"
# Words of errors that mean the store cannot be reached.
OUTAGE = ("fetch failed", "getaddrinfo", "enotfound", "econnrefused", "econnreset", "etimedout", "connection was refused", "origin_down", "web server is down", "network")

WEBHOOK = """struct<object:string,entry:array<struct<id:string,changes:array<struct<field:string,value:struct<
contacts:array<struct<profile:struct<name:string>,wa_id:string>>,messages:array<struct<`from`:string,id:string,timestamp:string,type:string,text:struct<body:string>>>>>>>>>"""


def is_reset(c: Column | str) -> Column:
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return text.rlike(RESET_ALONE) | text.rlike(RESET_PHRASE)


def is_unreachable(message: Column, status: Column) -> Column:
    text = F.lower(message)
    found = F.lit(False)
    for word in OUTAGE:
        found = found | text.contains(word)
    return F.coalesce(status >= 500, F.lit(False)) | F.coalesce(found, F.lit(False))


def webhook_messages(payloads: DataFrame, column: str, account: str) -> DataFrame:
    """Text messages of webhook payloads with the sender's first contact name."""
    p = payloads.select(F.from_json(column, WEBHOOK.replace("\n", "")).alias("p")).where(F.col("p.object") == account)
    changes = p.select(F.explode("p.entry").alias("e")).select(F.explode("e.changes").alias("c")).where("c.field = 'messages'").select("c.value.contacts", F.explode("c.value.messages").alias("m"))
    name = F.get(F.filter("contacts", lambda c: c["wa_id"] == F.col("m.from")), 0)["profile"]["name"]
    rows = changes.where("m.type = 'text'").select(F.col("m.id").alias("msg_id"), F.col("m.from").alias("phone"), name.alias("name"), F.trim("m.text.body").alias("content"), F.col("m.timestamp").cast("long").alias("sent"))
    return rows.where("content <> ''")


def new_messages(incoming: DataFrame, stored: DataFrame, key: str = "msg_id") -> DataFrame:
    """Incoming messages whose id is not stored yet, each once."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def recent_history(messages: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The last messages of each conversation, of these only what follows the user's last reset."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit)
    last = Window.partitionBy("conv_id")
    cut = F.max(F.when((F.col("role") == "user") & is_reset("text"), F.col("turn"))).over(last)
    return rows.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("turn") > F.col("_cut"))).drop("_n", "_cut")


def rollup(messages: DataFrame) -> DataFrame:
    """Last message, number of messages, and user messages since the last that a person or the assistant wrote."""
    answered = messages.where("role <> 'user'").groupBy("conv_id").agg(F.max("turn").alias("answered"))
    rows = messages.join(answered, "conv_id", "left")
    unread = F.count_if((F.col("role") == "user") & (F.col("turn") > F.coalesce("answered", F.lit(-1))))
    return rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_message"), F.max("turn").alias("last_turn"), F.count("*").cast("long").alias("n_messages"), unread.cast("long").alias("unread"))


def without_repeats(messages: DataFrame) -> DataFrame:
    """Messages that differ from the one before in their conversation."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("_before", F.lag(F.struct("role", "text")).over(before)).where(F.col("_before").isNull() | (F.col("_before") != F.struct("role", "text"))).drop("_before")


def found_by(conversations: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Conversations in which a column holds a text, case aside; wildcards of the text are dropped."""
    wanted = "%" + "".join(c for c in text if c not in "%_,()\\") + "%"
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).ilike(wanted), F.lit(False))
    return conversations.where(cond)


def conversations_of(messages: DataFrame) -> DataFrame:
    """One row a phone: the first name known, and its first and last message."""
    return messages.groupBy("phone").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("sent"))).alias("name"), F.max_by("content", "sent").alias("last_message"), F.count("*").cast("long").alias("unread"))
