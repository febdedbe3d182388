"""Requests by their parameters: which query or update they are, and its result as rows for HTTP."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import join_list
from ..graph import Graph
from . import complex_reads as ic, short_reads as short, updates


def _int(p: dict, key: str) -> int:
    return int(p.get(key) or 0)


def _str(p: dict, key: str) -> str:
    return str(p.get(key) or "")


def _limit(p: dict, default: int) -> int:
    return int(p["limit"]) if isinstance(p.get("limit"), int) and p["limit"] > 0 else default


#: The key that tells a read, and the read of a graph and its parameters.
READS: dict[str, tuple[str, Callable[[Graph, dict], DataFrame]]] = {
    "is1": ("personIdSQ1", lambda g, p: short.is1(g, _int(p, "personIdSQ1"))),
    "is2": ("personIdSQ2", lambda g, p: short.is2(g, _int(p, "personIdSQ2"), min(_limit(p, 20), 10))),
    "is3": ("personIdSQ3", lambda g, p: short.is3(g, _int(p, "personIdSQ3"))),
    "is4": ("messageIdContent", lambda g, p: short.is4(g, _int(p, "messageIdContent"))),
    "is5": ("messageIdCreator", lambda g, p: short.is5(g, _int(p, "messageIdCreator"))),
    "is6": ("messageForumId", lambda g, p: short.is6(g, _int(p, "messageForumId"))),
    "is7": ("messageRepliesId", lambda g, p: short.is7(g, _int(p, "messageRepliesId"))),
    "ic1": ("personIdQ1", lambda g, p: ic.ic1(g, _int(p, "personIdQ1"), _str(p, "firstName"), _limit(p, 20))),
    "ic2": ("personIdQ2", lambda g, p: ic.ic2(g, _int(p, "personIdQ2"), _int(p, "maxDate"), _limit(p, 20))),
    "ic3": ("personIdQ3", lambda g, p: ic.ic3(g, _int(p, "personIdQ3"), _str(p, "countryXName"), _str(p, "countryYName"), _int(p, "startDate"), _int(p, "durationDays"), _limit(p, 20))),
    "ic4": ("personIdQ4", lambda g, p: ic.ic4(g, _int(p, "personIdQ4"), _int(p, "startDate"), _int(p, "durationDays"), _limit(p, 20))),
    "ic5": ("personIdQ5", lambda g, p: ic.ic5(g, _int(p, "personIdQ5"), _int(p, "minDate"), _limit(p, 20))),
    "ic6": ("personIdQ6", lambda g, p: ic.ic6(g, _int(p, "personIdQ6"), _str(p, "tagName"), _limit(p, 20))),
    "ic7": ("personIdQ7", lambda g, p: ic.ic7(g, _int(p, "personIdQ7"), _limit(p, 20))),
    "ic8": ("personIdQ8", lambda g, p: ic.ic8(g, _int(p, "personIdQ8"), _limit(p, 20))),
    "ic9": ("personIdQ9", lambda g, p: ic.ic9(g, _int(p, "personIdQ9"), _int(p, "maxDate"), _limit(p, 20))),
    "ic10": ("personIdQ10", lambda g, p: ic.ic10(g, _int(p, "personIdQ10"), _int(p, "month"), _limit(p, 20))),
    "ic11": ("personIdQ11", lambda g, p: ic.ic11(g, _int(p, "personIdQ11"), _str(p, "countryName"), _int(p, "workFromYear"), _limit(p, 20))),
    "ic12": ("personIdQ12", lambda g, p: ic.ic12(g, _int(p, "personIdQ12"), _str(p, "tagClassName"), _limit(p, 20))),
    "ic13": ("person1IdQ13StartNode", lambda g, p: ic.ic13(g, _int(p, "person1IdQ13StartNode"), _int(p, "person2IdQ13EndNode"))),
    "ic14": ("person1IdQ14StartNode", lambda g, p: ic.ic14(g, _int(p, "person1IdQ14StartNode"), _int(p, "person2IdQ14EndNode"))),
}
#: Limits over HTTP, where they aren't 20.
HTTP_LIMITS = {"ic4": 10, "ic6": 10, "ic10": 10, "ic11": 10, "is2": 10}


def read_of(params: dict, hint: str | None = None) -> str:
    """The read that the parameters' distinctive key names; short reads come first."""
    for name, (key, _) in READS.items():
        if key in params and hint in (None, name):
            return name
    raise KeyError(f"no read has the parameters {sorted(params)}")


def update_of(params: dict) -> int:
    """The update whose parameters these are."""
    keys = set(params)
    for op, needed in (
        (updates.ADD_PERSON, {"personId", "firstName"}), (updates.ADD_FORUM, {"forumId", "forumTitle"}), (updates.ADD_POST, {"postId", "authorPersonId"}), (updates.ADD_COMMENT, {"commentId", "authorPersonId"}),
        (updates.ADD_FRIEND, {"person1Id", "person2Id"}), (updates.ADD_MEMBER, {"forumId", "personId", "joinDate"}), (updates.LIKE_POST, {"personId", "postId"}), (updates.LIKE_COMMENT, {"personId", "commentId"}),
    ):
        if needed <= keys:
            return op
    raise KeyError(f"no update has the parameters {sorted(params)}")


def run(g: Graph, params: dict, hint: str | None = None) -> DataFrame:
    return READS[read_of(params, hint)][1](g, params)


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def rows(df: DataFrame) -> list[dict]:
    """The result with camel-case names; a query's limit or its few rows bound it."""
    return [{camel(k): v for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


#: The field names of the HTTP answers where they aren't the columns' names in camel case.
_PERSON = {"person_first_name": "firstName", "person_last_name": "lastName"}
_FRIEND_MESSAGE = {"person_id": "friendId", **_PERSON, "message_content": "content", "message_creation_date": "creationDate"}
HTTP_FIELDS: dict[str, dict[str, str]] = {
    "ic1": {
        "friend_id": "personId", "friend_last_name": "lastName", "distance_from_person": "distance", "friend_birthday": "birthday", "friend_creation_date": "creationDate", "friend_gender": "gender", "friend_browser_used": "browserUsed",
        "friend_location_ip": "locationIp", "friend_emails": "email", "friend_languages": "language", "friend_city_name": "cityName", "friend_universities": "universities", "friend_companies": "companies",
    },
    "ic2": _FRIEND_MESSAGE, "ic3": _PERSON, "ic7": {**_PERSON, "like_creation_date": "likeTime"}, "ic8": _PERSON, "ic9": _FRIEND_MESSAGE,
    "ic10": {**_PERSON, "common_interest_score": "score", "person_gender": "gender", "person_city_name": "cityName"}, "ic11": {**_PERSON, "organization_work_from_year": "workFromYear"}, "ic12": {**_PERSON, "reply_count": "count"},
    "is2": {"message_content": "content", "message_creation_date": "creationDate", "original_post_author_first_name": "firstName", "original_post_author_last_name": "lastName"},
    "is4": {"message_content": "content", "message_creation_date": "creationDate"}, "is6": {"moderator_id": "moderatorPersonId"},
    "is7": {"comment_content": "content", "comment_creation_date": "creationDate", "reply_author_first_name": "firstName", "reply_author_last_name": "lastName"},
}
#: Reads whose answer is one object, or null.
SINGLE = {"ic13", "is1", "is4", "is5", "is6"}


def answer(read: str, df: DataFrame) -> object:
    """The HTTP answer: fields by their names there, the lists of ic1 as ``;`` strings and its organisations as triples."""
    names, out = HTTP_FIELDS.get(read, {}), []
    if read == "ic1":
        df = df.withColumns({"friend_emails": join_list("friend_emails"), "friend_languages": join_list("friend_languages")})
    for r in df.collect():
        row = {names.get(k, camel(k)): v for k, v in r.asDict(recursive=True).items()}
        out.append({k: [list(x.values()) for x in v] if k in ("universities", "companies") and v is not None else v for k, v in row.items()})
    return (out[0] if out else None) if read in SINGLE else out


def parse_query_list(raw: str) -> list[str]:
    """``ic``, ``is``, ``read`` (both) or names between commas."""
    out: list[str] = []
    for part in filter(None, (x.strip().lower() for x in raw.split(","))):
        if part not in ("ic", "is", "read") and part not in READS:
            raise ValueError(f"unknown query {part}")
        out += [n for n in READS if part == n or part == "read" or part in ("ic", "is") and n.startswith(part)]
    return list(dict.fromkeys(out))
