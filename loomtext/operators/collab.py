"""The document-collaboration store: ownership, sharing, edits, chat, notifications, requests and their messages."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from loomtext.operators.rope import Rope, moved

#: Result codes and their messages; 999 stands for what is unknown.
MESSAGES = {
    "000": "Success",
    "001": "Sign up successfully",
    "002": "Successfully Connect Websocket",
    "101": "Django Error",
    "102": "Username has been registered",
    "103": "Username should only contain digits!",
    "104": "Email has been registered",
    "105": "Illegal email format",
    "106": "Repeat password is not the same with origin password",
    "107": "Username or password wrong",
    "108": "User not active",
    "109": "Document Title could not be empty",
    "110": "Require document id",
    "111": "Cannot find document id",
    "112": "Not recognize request path",
    "113": "Malformed request",
    "114": "Nickname needed in chat request",
    "115": "Docid needed in chat request",
    "116": "User id needed in request",
    "117": "User not found",
    "118": "Indice error",
    "119": "Illegal docid",
    "120": "User not log in",
    "121": "Unsupported Request Method",
    "122": "Document has been deleted",
    "123": "Illegal Token",
    "124": "Email not found",
    "125": "Change password failed",
    "126": "Unsupported notification type",
    "127": "No such notification",
    "128": "Sending email failed",
    "999": "Unknow Error",
}
#: Actions of one part, and the second parts of those of two.
WHOLE_ACTIONS, EDIT_ACTIONS = ("chat", "addUser", "delUser"), ("init", "add", "delete", "update")
#: The most characters of names and passwords, and of an address that asks for a new password.
NAME_CHARS, MAIL_CHARS = 50, 100


def owned(docs: DataFrame, user: int) -> DataFrame:
    """A user's own documents that are not deleted, latest first."""
    return docs.filter((F.col("creator") == user) & (F.col("is_delete") == "0")).orderBy(F.desc("saved"), "doc_id")


def shared(docs: DataFrame, shares: DataFrame, user: int) -> DataFrame:
    """Documents shared with a user, not deleted, latest first."""
    mine = shares.filter(F.col("user_id") == user).select("doc_id")
    return docs.filter(F.col("is_delete") == "0").join(mine, "doc_id", "left_semi").orderBy(F.desc("saved"), "doc_id")


def _rights(docs: DataFrame, shares: DataFrame) -> DataFrame:
    """user_id, doc_id of everyone who created a document or shares it: two ways as a union, so that either joins by hash."""
    return docs.select(F.col("creator").alias("user_id"), "doc_id").unionByName(shares.select("user_id", "doc_id")).distinct().withColumn("may", F.lit(True))


def access(requests: DataFrame, docs: DataFrame, shares: DataFrame) -> DataFrame:
    """Requests (user_id, doc_id) with a code: 111 for a document that is missing or not the user's to see, 122 for a deleted one, 000.

    Requests may have ``signed_in``; 120 where it is false.
    """
    joined = requests.join(_rights(docs, shares), ["user_id", "doc_id"], "left").join(docs.select("doc_id", "is_delete"), "doc_id", "left")
    out = F.when(~F.col("signed_in"), "120") if "signed_in" in requests.columns else F.when(F.lit(False), "120")
    code = out.when(F.col("is_delete").isNull() | F.col("may").isNull(), "111").when(F.col("is_delete") == "1", "122").otherwise("000")
    return joined.select("user_id", "doc_id", code.alias("code"))


def with_messages(rows: DataFrame, code: str = "code") -> DataFrame:
    """Adds the message of a code."""
    table = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    return rows.withColumn("message", F.coalesce(F.try_element_at(table, F.col(code)), F.lit(MESSAGES["999"])))


def delete(docs: DataFrame, shares: DataFrame, notices: DataFrame, doc_id: int | None, user: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, shares and notices after a user deletes a document, or all that are theirs (None), and the code.

    The owner marks it deleted and its notices go; one it is shared with only leaves it.
    """
    named = F.lit(True) if doc_id is None else F.col("doc_id") == doc_id
    mine, with_me = named & (F.col("creator") == user), named & (F.col("user_id") == user)
    owner = docs.filter(mine).select("doc_id")
    after = docs.withColumn("is_delete", F.when(mine, "1").otherwise(F.col("is_delete")))
    left = shares.filter(~with_me)
    kept = notices.join(owner, "doc_id", "left_anti")
    code = owner.unionByName(shares.filter(with_me).select("doc_id")).agg(F.when(F.count("*") > 0, "000").otherwise("111").alias("code"))
    return after, left, kept, code


def rename(docs: DataFrame, shares: DataFrame, doc_id: int, user: int, title: str) -> tuple[DataFrame, DataFrame]:
    """The owner's new title; it always clears the share list."""
    mine = (F.col("doc_id") == doc_id) & (F.col("creator") == user)
    after = docs.withColumn("title", F.when(mine, F.lit(title)).otherwise(F.col("title")))
    return after, shares.join(docs.filter(mine).select("doc_id"), "doc_id", "left_anti")


def invite(users: DataFrame, names: str, sender: int, doc_id: int) -> DataFrame:
    """One notice of type 0 for each known name of a comma list."""
    asked = users.sparkSession.range(1).select(F.explode(F.split(F.lit(names), ",")).alias("username")).select(F.trim("username").alias("username")).filter("username <> ''").distinct()
    return asked.join(users, "username").select(F.lit(sender).alias("sender"), F.col("user_id").alias("receiver"), F.lit(doc_id).alias("doc_id"), F.lit("0").alias("message_type"), F.lit("0").alias("has_read"))


def signup_code(users: DataFrame, taken: DataFrame) -> DataFrame:
    """Requests (request_id, username, email, password, confirm) with the first failing check as code.

    taken: username, email of known users. Duplicates come by semi joins on either column.
    """
    from loomtext.functions.text import is_email, is_username

    names = taken.select(F.col("username"), F.lit(True).alias("name_taken")).distinct()
    mails = taken.select(F.col("email"), F.lit(True).alias("mail_taken")).distinct()
    joined = users.join(names, "username", "left").join(mails, "email", "left")
    missing = F.greatest(*(F.coalesce(F.col(c), F.lit("")) == "" for c in ("username", "email", "password", "confirm")))
    code = (
        F.when(missing, "113").when(F.col("name_taken"), "102").when(~is_username(F.col("username")), "103")
        .when(F.col("mail_taken"), "104").when(~is_email(F.col("email")), "105").when(F.col("password") != F.col("confirm"), "106").otherwise("000")
    )
    return joined.select("request_id", code.alias("code"))


def splice(text: Column, action: Column, start: Column, end: Column, content: Column, client: bool = False) -> Column:
    """One edit: add inserts at start, update replaces [start, end), all else cuts it. Slices clamp.

    ``client``: an add removes [start, end) too, as browsers rebase it.
    """
    n = F.length(text)
    low = F.least(F.greatest(start, F.lit(0)), n)
    high = F.greatest(low, F.least(end, n))
    after = F.when(action == "add", high if client else low).otherwise(high)
    middle = F.when(action.isin("add", "update"), content).otherwise(F.lit(""))
    return F.concat(F.substring(text, F.lit(1), low), middle, F.substring(text, after + 1, n))


_EDIT = ("doc_id", "seq", "action", "start", "end", "content")


def fold_edits(edits: DataFrame, initial: DataFrame | None = None, client: bool = False) -> DataFrame:
    """doc_id, content, n_edits after all edits (doc_id, seq, action, start, end, content) in order of seq.

    Edits are dealt out by document, sorted, and streamed through a rope (``operators.rope``), so a task holds one
    document's text and an edit costs the same whether it is the first or the hundred thousandth. Edits with a
    ``base`` were made against that version of the document (the number of edits before it) and are rebased: their
    places move with the edits since. initial: doc_id, text of documents before their edits; those without edits have no row.
    """
    based = "base" in edits.columns
    columns = [*(F.col(c) for c in _EDIT), (F.col("base") if based else F.lit(None)).cast("long").alias("base")]
    rows = edits.select(*columns).withColumn("first", F.lit(1))
    if initial is not None:
        known = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("seq", "action", "start", "end")]
        rows = rows.unionByName(initial.select("doc_id", *known, F.col("text").alias("content"), F.lit(None).cast("long").alias("base"), F.lit(0).alias("first")))
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "first", "seq", "action", "start", "end", "content")
    schema = T.StructType([edits.schema["doc_id"], T.StructField("content", T.StringType()), T.StructField("n_edits", T.LongType())])

    def run(batches):
        names = schema.fieldNames()
        key, rope, done, n, begun = None, Rope(), [], 0, False

        def out():
            return [(key, rope.text(), n)] if begun and n else []

        for batch in batches:
            made = []
            for doc_id, _, action, start, end, content, base, first in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or doc_id != key:
                    made += out()
                    key, rope, done, n, begun = doc_id, Rope(), [], 0, True
                if first == 0:
                    rope = Rope(content or "")
                    continue
                start, end = rebased(start, end, done[base:] if base is not None else ())
                done_now = rope.edit(action, start, end, content, client)
                n += 1
                if based:
                    done.append(done_now)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)
        if out():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out()), types)], names)

    types = [to_arrow_type(f.dataType) for f in schema.fields]
    return ordered.mapInArrow(run, schema)


def rebased(start: int | None, end: int | None, since) -> tuple[int, int]:
    """An edit's places after the edits made since its version."""
    start, end = start or 0, end or 0
    for low, high, put in since:
        start, end = moved(start, low, high, put), moved(end, low, high, put)
    return start, end


def caret(position: Column, end: Column, action: Column, start: Column, content: Column) -> Column:
    """A caret after another's edit: it moves if the edit ended at or before it."""
    grown = F.when(action == "delete", start - end).when(action == "update", F.length(content) - (end - start)).otherwise(F.length(content))
    return F.when(end <= position, position + grown).otherwise(position)


def difference(pairs: DataFrame) -> DataFrame:
    """Adds ``action, start, end, content``: the edit from ``before`` to ``after``, between their common prefix and suffix.

    Two empty texts make no edit; equal texts make an empty add.
    """
    a, b = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    with_left = pairs.withColumn("_a", a).withColumn("_b", b).withColumn("_left", _common(F.col("_a"), F.col("_b"), lambda t, n: F.substring(t, F.lit(1), n), F.least(F.length("_a"), F.length("_b"))))
    rest = F.least(F.length("_a"), F.length("_b")) - F.col("_left")
    ends = lambda t, n: F.substring(t, F.length(t) - n + 1, n)
    both = with_left.withColumn("_right", _common(F.col("_a"), F.col("_b"), ends, rest))
    some = (F.length("_a") > 0) | (F.length("_b") > 0)
    end = F.length("_a") - F.col("_right")
    put = F.substring(F.col("_b"), F.col("_left") + 1, F.length("_b") - F.col("_right") - F.col("_left"))
    kind = F.when(end == F.col("_left"), "add").when(F.length(put) > 0, "update").otherwise("delete")
    made = {"action": kind, "start": F.col("_left").cast("long"), "end": end.cast("long"), "content": put}
    return both.select(*pairs.columns, *(F.when(some, v).alias(k) for k, v in made.items()))


def _common(a: Column, b: Column, part, most: Column) -> Column:
    """The largest n up to ``most`` for which part(a, n) equals part(b, n), by halving."""
    steps = F.sequence(F.lit(0), F.length(F.bin(most)))

    def halve(s, _):
        middle = F.shiftright(s["low"] + s["high"] + 1, 1)
        up, down = F.struct(middle.alias("low"), s["high"].alias("high")), F.struct(s["low"].alias("low"), (middle - 1).alias("high"))
        return F.when(s["low"] >= s["high"], s).when(part(a, middle) == part(b, middle), up).otherwise(down)

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), most.alias("high")), halve, lambda s: s["low"])


def route(messages: DataFrame, users: DataFrame, docs: DataFrame, shares: DataFrame) -> DataFrame:
    """Raw JSON messages (id, raw) with action, channel, doc_id and a code, by the checks in their order.

    113 for what is no message, lacks a field, or has ids or places that are no numbers (a JSON null is a field that is there, and a place may
    be a JSON number with a fraction); 117 for an unknown user
    (users: user_id); 111 for a document that is missing or not the user's to see, 122 for a deleted one; then an
    action of one part is known or 113, the second part of one of two is known or 112, and more parts are 113.
    """
    schema = "data struct<action:string,uid:string,docid:string,start:string,end:string,content:string,shared_user:string>"
    number = lambda c: F.coalesce(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.lit(False))
    as_long = lambda c: F.when(number(c), F.try_to_number(F.trim(c), F.lit("S999999999999999999"))).cast("long")
    parsed = messages.withColumn("d", F.from_json("raw", schema)["data"]).withColumn("parts", F.split(F.regexp_replace("d.action", "^/+|/+$", ""), "/"))
    parsed = parsed.withColumn("fields", F.map_keys(F.from_json("raw", "data map<string,string>")["data"])).withColumn("places", F.from_json("raw", "data struct<start:double,end:double>")["data"])
    there = lambda c: F.coalesce(F.array_contains("fields", c), F.lit(False))
    place = lambda c: number(F.col(f"d.{c}")) | F.col(f"places.{c}").isNotNull()
    parsed = parsed.withColumn("user_id", as_long(F.col("d.uid"))).withColumn("doc_id", as_long(F.col("d.docid")))
    known = users.select("user_id", F.lit(True).alias("known")).distinct()
    joined = parsed.join(known, "user_id", "left").join(_rights(docs, shares), ["user_id", "doc_id"], "left").join(docs.select("doc_id", "is_delete"), "doc_id", "left")
    n, first, second = F.size("parts"), F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    named = F.col("d.action").isNotNull()
    code = (
        F.when(~F.coalesce(named, F.lit(False)) | ~number(F.col("d.uid")), "113").when(F.col("known").isNull(), "117").when(~number(F.col("d.docid")), "113")
        .when(F.col("may").isNull() | F.col("is_delete").isNull(), "111").when(F.col("is_delete") == "1", "122").when(~there("content"), "113")
        .when(n == 1, F.when(first == "chat", "000").when(first.isin(*WHOLE_ACTIONS) & there("shared_user"), "000").otherwise("113"))
        .when(n > 2, "113").when(~second.isin(*EDIT_ACTIONS), "112").when(second == "init", "000")
        .when(place("start") & place("end"), "000").otherwise("113")
    )
    return joined.select("id", F.when(n <= 2, F.element_at("parts", -1)).alias("action"), first.alias("channel"), "doc_id", code.alias("code"))


def notice_code(messages: DataFrame, users: DataFrame, notices: DataFrame) -> DataFrame:
    """Requests on notices (id, message_type, doc_id, nid, other_user) with a code: 126 for an unknown type, 113 for a missing field, 127 for no such notice, 117 for an unknown user.

    An invitation names its user, an answer gives a number; users: user_id, username. Type 3, read, asks for no user.
    """
    by_name = users.select(F.col("username").alias("other_user"), F.lit(True).alias("named")).distinct()
    by_id = users.select(F.col("user_id").cast("string").alias("other_user"), F.lit(True).alias("numbered")).distinct()
    known = notices.select("nid", F.lit(True).alias("there")).distinct()
    kind = F.col("message_type")
    joined = messages.join(by_name, "other_user", "left").join(by_id, "other_user", "left").join(known, "nid", "left")
    invites = F.when(F.col("doc_id").isNull() | F.col("other_user").isNull(), "113").when(F.col("named").isNull(), "117").otherwise("000")
    answers = F.when(F.col("nid").isNull(), "113").when(F.col("there").isNull(), "127").when(kind == "3", "000").when(F.col("other_user").isNull(), "113").when(F.col("numbered").isNull(), "117").otherwise("000")
    return joined.select("id", F.when(kind.isNull(), "113").when(~kind.isin("0", "1", "2", "3"), "126").when(kind == "0", invites).otherwise(answers).alias("code"))


def _given(*columns: str, most: int = NAME_CHARS) -> Column:
    """Whether all fields of a form are there and none is too long."""
    return reduce(Column.__and__, (F.coalesce(F.length(F.trim(F.col(c))), F.lit(0)).between(1, most) for c in columns))


def signin_code(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests (request_id, username, password): 113 for a bad field, 107 for a name or password that does not fit, 000. accounts: username, password."""
    fits = accounts.select("username", "password", F.lit(True).alias("fits")).distinct()
    joined = requests.join(fits, ["username", "password"], "left")
    return joined.select("request_id", F.when(~_given("username", "password"), "113").when(F.col("fits").isNull(), "107").otherwise("000").alias("code"))


def activate_code(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests (request_id, username, token): 113 for a bad field, 107 for an unknown user, 123 for another token, 000. accounts: username, token, one row a name."""
    joined = requests.join(accounts.select("username", F.col("token").alias("of_user"), F.lit(True).alias("known")), "username", "left")
    same = F.col("token").eqNullSafe(F.col("of_user"))
    return joined.select("request_id", F.when(~_given("username", "token"), "113").when(F.col("known").isNull(), "107").when(~same, "123").otherwise("000").alias("code"))


def forget_code(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests (request_id, email): 113 for what is no address, 124 for an unknown one, 000. accounts: email."""
    from loomtext.functions.text import is_email

    joined = requests.join(accounts.select("email", F.lit(True).alias("known")).distinct(), "email", "left")
    good = _given("email", most=MAIL_CHARS) & F.coalesce(is_email(F.col("email")), F.lit(False))
    return joined.select("request_id", F.when(~good, "113").when(F.col("known").isNull(), "124").otherwise("000").alias("code"))


def reset_code(requests: DataFrame) -> DataFrame:
    """Requests (request_id, password, repeat): 113 for a bad field, 106 where the two differ, 000."""
    return requests.select("request_id", F.when(~_given("password", "repeat"), "113").when(F.col("password") != F.col("repeat"), "106").otherwise("000").alias("code"))


def stays(events: DataFrame) -> DataFrame:
    """room, user_id, since, until: when users are in rooms, from events (room, seq, user_id, action join or leave). until is null for those who are still there.

    A second join without a leave between them, and a leave of one who is not there, change nothing.
    """
    own = Window.partitionBy("room", "user_id").orderBy("seq")
    turns = events.withColumn("before", F.lag("action").over(own)).filter(~F.col("action").eqNullSafe(F.coalesce("before", F.lit("leave"))))
    return turns.withColumn("until", F.lead("seq").over(own)).filter("action = 'join'").select("room", "user_id", F.col("seq").alias("since"), "until")


def present(at: DataFrame, stayed: DataFrame) -> DataFrame:
    """Rows (room, seq, ...) once for each user that is in the room then, as ``receiver``: an equi-join by room, narrowed by time."""
    there = stayed.select("room", F.col("user_id").alias("receiver"), "since", "until")
    joined = at.join(there, "room").filter((F.col("since") <= F.col("seq")) & (F.col("until").isNull() | (F.col("seq") < F.col("until"))))
    return joined.drop("since", "until")


def welcomes(events: DataFrame) -> DataFrame:
    """room, seq, user_id, receiver: who joins is announced to all in the room, themselves too."""
    stayed = stays(events)
    return present(stayed.select("room", F.col("since").alias("seq"), "user_id"), stayed)


def broadcasts(events: DataFrame) -> DataFrame:
    """room, seq, receivers: how many others are in the room at each event (room, seq, user_id, action), where there are any.

    Joins less leaves are summed along a room and the sender is taken off, so no event meets the stays of its room; a task
    sorts one room at least. Events without a room, a place or a user count for nothing.
    """
    own, room = Window.partitionBy("room", "user_id").orderBy("seq"), Window.partitionBy("room").orderBy("seq")
    there = F.coalesce(F.col("action") == "join", F.lit(False)).cast("int")
    rows = events.select("room", "seq", "user_id", there.alias("there")).dropna()
    turns = rows.select("room", "seq", (F.col("there") - F.lag("there", 1, 0).over(own)).alias("change"), F.last("there").over(own).alias("sender"))
    same = room.rangeBetween(Window.currentRow, Window.currentRow)
    receivers = F.sum("change").over(room) * F.count("*").over(same) - F.sum("sender").over(same)
    sent = turns.select("room", "seq", receivers.alias("receivers"), F.lead("seq").over(room).alias("after"))
    return sent.filter((F.col("receivers") > 0) & ~F.col("seq").eqNullSafe(F.col("after"))).select("room", "seq", "receivers")


def dispatch(packets: DataFrame) -> DataFrame:
    """Adds ``target``, where a client takes a packet (flag, action): a failure leads to the login or the profile page, a success to the chat, the editor or the access list."""
    action = F.coalesce("action", F.lit(""))
    went = F.when(F.col("flag") == "120", "login").when(F.col("flag") != "000", "profile")
    return packets.withColumn("target", went.when(action.contains("chat"), "chat").when(action.contains("doc"), "editor").when(action.contains("access"), "access"))


#: Fixed values, in milliseconds: the first delay of a client that connects again, its growth, and the longest.
FIRST_DELAY, DELAY_GROWTH, LONGEST_DELAY = 1000, 1.5, 50_000


def reconnect_delay(attempt: Column) -> Column:
    """Milliseconds before an attempt, counted from 0."""
    return F.least(F.lit(float(LONGEST_DELAY)), F.lit(float(FIRST_DELAY)) * F.pow(F.lit(DELAY_GROWTH), attempt.cast("double")))


def key_values(operations: DataFrame) -> DataFrame:
    """key, value, members, counter after operations (key, seq, op, value): put and remove set the value, add puts it into a set, raise and lower count.

    Every part is an aggregation with partial sums, so a hot key is summed before it moves.
    """
    op = F.col("op")
    last = F.max_by(F.when(op == "put", F.col("value")), F.when(op.isin("put", "remove"), F.col("seq")))
    members = F.count_distinct(F.when(op == "add", F.col("value")))
    return operations.groupBy("key").agg(last.alias("value"), members.alias("members"), F.sum(F.when(op == "raise", 1).when(op == "lower", -1).otherwise(0)).alias("counter"))


def unread(notices: DataFrame, user: int) -> DataFrame:
    return notices.filter((F.col("receiver") == user) & (F.col("has_read") == "0"))


def notification_states(events: DataFrame) -> DataFrame:
    """nid, doc_id, state, has_read, shares, replies after events (nid, seq, doc_id, message_type) in order.

    0 invites; 1 accepts: read, shared, a reply; 2 rejects: read, a reply; 3 reads. Only the first answer to an invite counts.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "message_type")))
    start = F.struct(F.lit("none").alias("state"), F.lit("0").alias("has_read"), F.lit(0).alias("shares"), F.lit(0).alias("replies"))

    def step(s, e):
        t, open_ = e["message_type"], s["state"] == "invited"
        state = F.when(t == "0", "invited").when(open_ & (t == "1"), "accepted").when(open_ & (t == "2"), "rejected").otherwise(s["state"])
        read = F.when(t == "0", "0").when(t.isin("1", "2", "3") & (s["state"] != "none"), "1").otherwise(s["has_read"])
        shares = s["shares"] + F.when(open_ & (t == "1"), 1).otherwise(0)
        replies = s["replies"] + F.when(open_ & t.isin("1", "2"), 1).otherwise(0)
        return F.struct(state.alias("state"), read.alias("has_read"), shares.alias("shares"), replies.alias("replies"))

    per = events.groupBy("nid").agg(F.max("doc_id").alias("doc_id"), ordered.alias("events"))
    return per.select("nid", "doc_id", F.aggregate("events", start, step).alias("s")).select("nid", "doc_id", "s.*")


def notice_text(sender: Column, title: Column, kind: Column, ts: Column) -> Column:
    from loomtext.functions.text import written_time

    said = F.when(kind == "0", " invites you to ").when(kind == "1", " accepted your invitation to ").when(kind == "2", " rejected your invitation to ").otherwise(" wrote about ")
    return F.concat(sender, said, title, F.lit(" at "), written_time(ts))


def chat_history(messages: DataFrame, last: int) -> DataFrame:
    """The last messages of each room (room, seq, handle, message), by place from the end."""
    place = F.row_number().over(Window.partitionBy("room").orderBy(F.desc("seq")))
    return messages.withColumn("from_end", place.cast("long")).filter(F.col("from_end") <= last)


def document_json(docs: DataFrame, shares: DataFrame, users: DataFrame) -> DataFrame:
    """doc_id, json: a document with the names it is shared with; one join and one aggregation for all documents."""
    named = shares.join(users, "user_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("username")).alias("shared"))
    joined = docs.join(named, "doc_id", "left")
    body = F.struct("doc_id", "title", F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))
    return joined.select("doc_id", F.to_json(F.struct(F.lit("000").alias("flag"), body.alias("data"), F.lit(MESSAGES["000"]).alias("message"))).alias("json"))


def create(docs: DataFrame, doc_id: int, user: int, title: str, content: str) -> DataFrame:
    """The documents and a new one. An empty title, or one over 100 characters, raises."""
    if not title or len(title) > 100:
        raise ValueError("a title has 1 to 100 characters")
    new = docs.sparkSession.range(1).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(title).alias("title"), F.lit(user).cast("long").alias("creator"), F.current_timestamp().alias("saved"), F.lit("0").alias("is_delete"), F.lit(content).alias("content"))
    return docs.unionByName(new, allowMissingColumns=True)


def share(shares: DataFrame, docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Shares after changes (doc_id, by, user_id, action add or remove) by the documents' creators; others' changes do nothing."""
    allowed = changes.join(docs.select("doc_id", F.col("creator").alias("by")), ["doc_id", "by"], "left_semi")
    gone = allowed.filter("action = 'remove'").select("doc_id", "user_id")
    new = allowed.filter("action = 'add'").select("doc_id", "user_id")
    return shares.join(gone, ["doc_id", "user_id"], "left_anti").unionByName(new).distinct()


def fan_out(messages: DataFrame, members: DataFrame) -> DataFrame:
    """Every message (room, seq, handle, message) once for each other member (room, handle) of its room."""
    to = members.select("room", F.col("handle").alias("receiver"))
    return messages.join(to, "room").filter(F.col("receiver") != F.col("handle"))


def input_code(rows: DataFrame, most: int = 20) -> DataFrame:
    """request_id, code of the checks that a browser makes: fields are there and not too long, an avatar is an image."""
    filled = lambda c: F.coalesce(F.length(c), F.lit(0)).between(1, most)
    name = F.lower(F.coalesce("avatar", F.lit("")))
    image = (name == "") | name.endswith(".png") | name.endswith(".jpg") | name.endswith(".jpeg")
    return rows.select("request_id", F.when(~(filled("username") & filled("nickname") & filled("password")), "length").when(~image, "avatar").otherwise("ok").alias("code"))
