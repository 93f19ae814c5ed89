"""Conversation state from a turn ledger (conv_id, turn, role, text)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import codes as K
from brindle.functions import text as T


def latest_turn(turns: DataFrame) -> DataFrame:
    """The last turn of each conversation, and the number of the next."""
    return turns.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"), (F.max("turn") + 1).alias("next_turn"), F.count("*").alias("n_turns"))


def last_active(turns: DataFrame, pattern: str) -> DataFrame:
    """What each turn's slot holds: the newest match of the pattern so far in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    found = F.regexp_extract("text", pattern, 0)
    return turns.select("conv_id", "turn", F.last(F.when(found != "", found), ignorenulls=True).over(w).alias("slot"))


def unsupported_numbers(turns: DataFrame) -> DataFrame:
    """Assistant turns: how many of their numbers do not occur in the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    told = F.array_distinct(T.all_of(F.col("text"), T.NUMBER))
    rows = turns.select("conv_id", "turn", "role", told.alias("said"), F.lag(told).over(w).alias("before"))
    missing = F.size(F.array_except("said", F.coalesce("before", F.array().cast("array<string>"))))
    return rows.where("role = 'assistant'").select("conv_id", "turn", F.size("said").cast("long").alias("n_numbers"), missing.cast("long").alias("n_unsupported"))


def slot_states(observations: DataFrame) -> DataFrame:
    """The state of each slot after each turn: conv_id, turn, slot, active, kind, changes.

    observations: conv_id, turn, slot, value, kind (explicit_user, vlm, ocr, ...), one per turn, slot and kind. What a user says
    stands until the user says otherwise; what was seen stands until something else is seen or said. Another product said
    by the user clears product, model and code first. changes counts the values that were active so far.
    """
    said = F.when(F.col("kind") == "explicit_user", F.col("value"))
    seen = F.when(F.col("kind") != "explicit_user", F.col("value"))
    rows = observations.where("value is not null and value <> ''").groupBy("conv_id", "turn", "slot").agg(F.max(said).alias("said"), F.max(seen).alias("seen"))
    before = Window.partitionBy("conv_id", "slot").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last("said", ignorenulls=True).over(before), F.last("seen", ignorenulls=True).over(before))
    reset = F.when((F.col("slot") == "product") & F.col("said").isNotNull() & (held != F.col("said")), 1).otherwise(0)
    marked = rows.withColumn("reset", reset)
    # the product's rows come first within a turn, as a reset clears the slots before they are set
    so_far = Window.partitionBy("conv_id").orderBy("turn", F.when(F.col("slot") == "product", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    clears = F.col("slot").isin("product", "model", "error_code")
    epochs = marked.withColumn("epoch", F.when(clears, F.sum("reset").over(so_far)).otherwise(0))
    upto = Window.partitionBy("conv_id", "slot", "epoch").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    last_said, last_seen = F.last("said", ignorenulls=True).over(upto), F.last("seen", ignorenulls=True).over(upto)
    active = epochs.withColumn("active", F.coalesce(last_said, last_seen)).withColumn("active_kind", F.when(last_said.isNotNull(), "explicit_user").otherwise("seen"))
    in_order = Window.partitionBy("conv_id", "slot").orderBy("turn")
    new = (F.lag("active").over(in_order).isNull() | (F.lag("active").over(in_order) != F.col("active")) | (F.lag("epoch").over(in_order) != F.col("epoch"))).cast("long")
    changed = active.withColumn("new", new)
    return changed.select("conv_id", "turn", "slot", "active", F.col("active_kind").alias("kind"), F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("changes"))


#: What a turn says about a slot; the first group holds the value.
SLOT_PATTERNS = {
    "model": r"(?i)型号(?:是|为|[:：])?\s*([A-Za-z0-9][A-Za-z0-9-]{1,40})",
    "error_code": r"(?i)(?:错误码|故障码|报错|显示)(?:是|为|[:：])?\s*((?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9-]{2,40})",
    "symptom": r"(?:现象|症状|表现)(?:是|为|[:：])?\s*(.{2,200})",
    "attempted_action": r"(?:已经|我已|之前)?\s*(?:尝试过|试过|做过)\s*(.{2,200})",
    "order_identifier": r"(?i)(?:订单号|订单编号|订单标识|单号)(?:是|为|[:：])?\s*([A-Za-z0-9][A-Za-z0-9-]{3,63})",
}
CORRECTION = r"(?i)不是\s*([A-Za-z0-9-]{2,40})\s*[，,、]?\s*(?:而)?是\s*([A-Za-z0-9-]{2,40})"


def said_slots(turns: DataFrame, patterns: dict[str, str] = SLOT_PATTERNS, correction: str = CORRECTION) -> DataFrame:
    """Observations of what users say: conv_id, turn, slot, value, kind. A correction names the new value of the code alone."""
    fixed = F.upper(F.regexp_extract("text", correction, 2))

    def value(slot: str) -> Column:
        found = F.regexp_extract("text", patterns[slot], 1)
        found = F.upper(found) if slot in ("model", "error_code", "order_identifier") else F.btrim(found)
        if slot == "error_code":
            found = F.when(fixed != "", fixed).when(found != "", found).otherwise(F.get(K.display_codes(F.col("text")), F.lit(0)))
            return F.coalesce(K.normalized_code(found), found)
        return F.when(fixed == "", found) if slot == "model" else found

    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), value(s).alias("value")) for s in patterns)))
    out = turns.where("role = 'user'").select("conv_id", "turn", rows.alias("x")).select("conv_id", "turn", "x.slot", "x.value")
    return out.where("value is not null and value <> ''").withColumn("kind", F.lit("explicit_user"))


_BARE = r"^(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9-]{2,40}$"
#: Endings of a bare product name.
_DEVICE = "(?:设备|机器|装置|终端|机器人|机|器|仪|表|柜|盒|泵|炉|车|锁|灯|扇|箱)"


def product_shape(text: Column) -> Column:
    """Whether a bare reply looks like a product: a name with a digit and a device word, or a brand and a device."""
    plain = F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    shape = plain.rlike(r"^(?=[a-z0-9-]*[a-z])(?=[a-z0-9-]*[0-9])[a-z0-9-]+ (?:设备|机器|装置|终端)$") | plain.rlike(rf"^[a-z0-9\-㐀-鿿]{{1,12}}牌[a-z0-9\-㐀-鿿]{{1,12}}{_DEVICE}$")
    return (F.length(plain) > 0) & (F.length(plain) <= 32) & ~plain.rlike("[?？。！!，,；;：:]") & shape


def pending_value(field: Column, text: Column) -> Column:
    """What a bare reply to a question for a field says; null where its shape is not that of the field."""
    t = F.btrim(F.coalesce(text, F.lit("")))
    bare = t.rlike(_BARE)
    return (
        F.when((field == "product") & product_shape(t), t)
        .when((field == "model") & bare, F.upper(t))
        .when((field == "error_code") & bare, F.coalesce(K.normalized_code(t), F.upper(t)))
        .when((field == "order_identifier") & t.rlike("^[A-Za-z0-9][A-Za-z0-9-]{3,63}$"), F.upper(t))
        .when(field.isin("symptom", "attempted_action", "service_request") & (t != ""), t)
    )


def topic_switched(field: Column, text: Column, has_image: Column, takes_image: Column, general: Column) -> Column:
    """Whether a reply leaves the pending question: not what was asked for, no image asked for, and a general request."""
    answers = pending_value(field, text).isNotNull() & ~field.isin("symptom", "attempted_action", "service_request")
    return ~(has_image & takes_image) & ~answers & general


def begun_turns(requests: DataFrame, owners: DataFrame) -> DataFrame:
    """Turns of new requests (conv_id, owner_id, request_id, text, at): a repeated request begins one turn, the next ordinals
    follow the order of time, and requests of another than the conversation's owner are refused.

    owners: conv_id, owner_id, last_ordinal of the conversations so far. Returns conv_id, request_id, ordinal, refused.
    """
    first = requests.groupBy("request_id").agg(F.min(F.struct("at", "conv_id", "owner_id")).alias("x")).select("request_id", "x.*")
    opened = first.groupBy("conv_id").agg(F.min_by("owner_id", F.struct("at", "request_id")).alias("first_owner"))
    rows = first.join(opened, "conv_id").join(owners.select("conv_id", F.col("owner_id").alias("old_owner"), "last_ordinal"), "conv_id", "left")
    refused = F.col("owner_id") != F.coalesce("old_owner", "first_owner")
    w = Window.partitionBy("conv_id", refused).orderBy("at", "request_id")
    ordinal = F.when(~refused, F.coalesce("last_ordinal", F.lit(0)) + F.row_number().over(w))
    return rows.select("conv_id", "request_id", ordinal.cast("long").alias("ordinal"), refused.alias("refused"))


def final_states(transitions: DataFrame) -> DataFrame:
    """The state of each request after its transitions (request_id, status, at): the first completion stands for good."""
    at = F.struct("at", "status")
    return transitions.groupBy("request_id").agg(F.coalesce(F.when(F.count_if(F.col("status") == "completed") > 0, F.lit("completed")), F.max_by("status", at)).alias("status"), F.min(F.when(F.col("status") == "completed", F.col("at"))).alias("completed_at"))


def newest_summaries(summaries: DataFrame, most: int = 4000) -> DataFrame:
    """The summary of each conversation that reaches furthest (conv_id, summary, through, at); of equals the later one."""
    best = summaries.groupBy("conv_id").agg(F.max_by("summary", F.struct("through", "at")).alias("summary"), F.max("through").alias("through"))
    return best.select("conv_id", F.substring(F.btrim("summary"), 1, most).alias("summary"), "through")


def prompt_window(turns: DataFrame, questions: DataFrame, budget: int) -> DataFrame:
    """Which turns go into a prompt: conv_id, ordinal, cost, taken.

    turns: conv_id, ordinal, text (a block of both sides) of completed turns; questions: conv_id, text, summary. The summary takes
    a quarter of the budget at most. From the newest back, a turn that does not fit is skipped and older ones are tried.
    Tasks stream sorted rows and carry one running sum, so a long conversation needs no memory.
    """
    q = F.col("text")
    rest = F.least(F.lit(budget // 4), F.lit(budget) - T.estimated_tokens(q))
    summary = T.estimated_tokens(F.col("summary"))
    start = questions.select("conv_id", (T.estimated_tokens(q) + F.least(summary, F.greatest(F.lit(0), rest))).cast("long").alias("start"))
    rows = turns.select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), T.estimated_tokens(q).alias("cost")).join(start, "conv_id").select("conv_id", "ordinal", "cost", "start")

    def run(batches):  # noqa: ANN001, ANN202
        last, used = object(), 0
        for batch in batches:
            taken = []
            for conv, cost, begin in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "cost", "start")), strict=True):
                if conv != last:
                    last, used = conv, begin
                fits = used + cost <= budget
                used += cost * fits
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "ordinal", "cost")), pa.array(taken, pa.bool_())], names=["conv_id", "ordinal", "cost", "taken"])

    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("ordinal"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return sorted_rows.mapInArrow(run, f"conv_id {kind}, ordinal long, cost long, taken boolean")


def session_memory(saves: DataFrame, ttl: str = "7 days") -> DataFrame:
    """What each save of a session keeps: session_id, at, products, switched, n_saves.

    saves: session_id, at, products (array). A gap of the time to live or more starts anew; products without a common one
    switch the topic; a save without products inherits the last ones.
    """
    w = Window.partitionBy("session_id").orderBy("at")
    fresh = F.when(F.col("at") - F.lag("at").over(w) < F.expr(f"interval {ttl}"), 0).otherwise(1)
    life = saves.withColumn("fresh", fresh).withColumn("life", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy("session_id", "life").orderBy("at")
    named = F.when(F.size("products") > 0, F.col("products"))
    before = F.last(named, ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1))
    kept = F.coalesce(F.last(named, ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, 0)), F.array().cast("array<string>"))
    switched = F.coalesce((F.size("products") > 0) & ~F.arrays_overlap("products", before), F.lit(False))
    return life.select("session_id", "at", kept.alias("products"), switched.alias("switched"), F.row_number().over(v).alias("n_saves"))


def relevant(memories: DataFrame, asked: DataFrame, now: Column, owner: Column) -> DataFrame:
    """Memories (session_id, owner_id, products, expires_at) that a question may use (asked: session_id, products): alive, of the
    owner, and not about other products."""
    rows = memories.join(asked.select("session_id", F.col("products").alias("asked")), "session_id")
    other = (F.size("asked") > 0) & (F.size("products") > 0) & ~F.arrays_overlap("asked", "products")
    return rows.where((F.col("expires_at") > now) & (F.col("owner_id") == owner) & ~other).drop("asked")


def entries(turns: DataFrame) -> DataFrame:
    """One row for each side of a turn (conv_id, ordinal, user_text, assistant_text): conv_id, place, role, text; empty sides go."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), F.col("user_text").alias("text")), F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), F.col("assistant_text").alias("text")))
    rows = turns.select("conv_id", "ordinal", F.explode(sides).alias("x")).where("coalesce(trim(x.text), '') <> ''")
    return rows.select("conv_id", (2 * F.col("ordinal") + F.col("x.side")).alias("place"), "x.role", "x.text")


def transcript_tail(turns: DataFrame, most: int = 8000) -> DataFrame:
    """conv_id and the last characters of its transcript (conv_id, turn, role, text).

    Only the newest turns that can reach into the tail are gathered: a running length from the end decides.
    """
    line = F.concat_ws(": ", "role", F.coalesce("text", F.lit("")))
    after = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select("conv_id", "turn", line.alias("line")).withColumn("later", F.coalesce(F.sum(F.length("line") + 1).over(after), F.lit(0))).where(F.col("later") <= most)
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("xs"))
    return lists.select("conv_id", F.expr(f"right(array_join(transform(xs, x -> x.line), '\n'), {most})").alias("tail"))


def without(tables: dict[str, DataFrame], key: str, ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the given ids: a delete that reaches every table that holds the key."""
    return {name: t.join(ids.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def attachments(items: Column) -> Column:
    """Name, kind, checksum and size of the first three attachments (structs); whatever else they hold goes."""
    return F.transform(F.slice(items, 1, 3), lambda x: F.struct(*(x[c].alias(c) for c in ("name", "mime", "sha256", "size"))))


def data_urls(urls: Column) -> Column:
    """Kind, checksum and payload length of the first three data URLs."""
    return F.transform(F.slice(urls, 1, 3), lambda u: F.struct(F.regexp_extract(u, "^data:([^;,]*)", 1).alias("mime"), F.sha2(u, 256).alias("sha256"), F.length(F.regexp_extract(u, "(?s),(.*)$", 1)).alias("size")))


def slot_text(slots: list[tuple[str, Column]]) -> Column:
    """One labelled line for each slot that has a value, in order."""
    return F.concat_ws("\n", *(F.when(v.isNotNull() & (F.btrim(v) != ""), F.concat(F.lit(f"{label}: "), v)) for label, v in slots))


def composed(route: Column, technical: Column, service: Column) -> Column:
    """The answer of a route: both parts with a heading for mixed, else the one of the route."""
    t, s = F.coalesce(technical, F.lit("")), F.coalesce(service, F.lit(""))
    both = F.btrim(F.concat(F.lit("技术处理\n"), t, F.lit("\n\n售后建议\n"), s))
    return F.when(route == "mixed", both).when(route == "customer_service", s).otherwise(t)
