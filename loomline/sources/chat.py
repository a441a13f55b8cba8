"""Chat dumps, room lists and a paged REST reader."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.text import collapse, safe_file_name

#: Keys under which a dump nests messages.
CONTAINERS = ("messages", "items", "posts", "results", "thread", "replies")
MESSAGE = "file string, message_id string, room_id string, parent_id string, author string, person_email string, created string, updated string, text string, markdown string, files array<string>"


def flatten(payload: object) -> Iterator[dict]:
    """Every object with a text id and a text, at any depth; an object comes before what it contains."""
    if isinstance(payload, list):
        for item in payload:
            yield from flatten(item)
    elif isinstance(payload, dict):
        if isinstance(payload.get("id"), str) and any(isinstance(payload.get(k), str) for k in ("markdown", "text", "body", "message")):
            yield payload
        for key in CONTAINERS:
            if isinstance(payload.get(key), list | dict):
                yield from flatten(payload[key])


def _row(file: str, m: dict) -> dict:
    first = lambda *keys: next((m[k] for k in keys if isinstance(m.get(k), str) and m[k].strip()), None)
    return {
        "file": file, "message_id": m["id"], "room_id": first("roomId", "spaceId"), "parent_id": first("parentId"), "author": first("personDisplayName", "displayName", "personEmail"),
        "person_email": first("personEmail"), "created": first("created"), "updated": first("updated"), "text": first("text", "body", "message"), "markdown": first("markdown"),
        "files": [f for f in m.get("files") or [] if isinstance(f, str)],
    }


def read_dump(spark: SparkSession, at: str) -> DataFrame:
    """Messages of all .json and .jsonl files under ``at``; a file that cannot be parsed gives none."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(at).select("path", "content")

    def parse(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    text = bytes(content).decode("utf-8")
                    payload = [json.loads(x) for x in text.splitlines() if x.strip()] if path.endswith(".jsonl") else json.loads(text)
                    rows += [_row(path, m) for m in flatten(payload)]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGE.split(", ")])

    return files.mapInPandas(parse, MESSAGE)


def rooms_of(rooms: DataFrame, kind: str = "all") -> DataFrame:
    """Distinct rooms of a kind (group, direct, all): least title and type per id."""
    if kind not in ("all", "group", "direct"):
        raise ValueError("kind must be one of: all, group, direct")
    clean = rooms.select(F.trim("room_id").alias("room_id"), collapse(F.col("title")).alias("title"), F.lower(F.trim("room_type")).alias("room_type")).where("room_id <> ''")
    picked = clean if kind == "all" else clean.where(F.col("room_type") == kind)
    return picked.groupBy("room_id").agg(F.min(F.struct("title", "room_type")).alias("r")).select("room_id", "r.title", "r.room_type")


def file_names(rooms: DataFrame, most: int = 80) -> DataFrame:
    """Adds ``base_name``: a safe title of at most ``most`` characters, unique by a suffix from the id where titles collide."""
    base = safe_file_name(F.col("title"), most)
    rows = rooms.withColumn("_b", base).withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("_b")).orderBy("room_id")))
    suffixed = F.concat(F.substring("_b", 1, most - 9), F.lit("_"), F.substring(F.sha1("room_id"), 1, 8))
    return rows.withColumn("base_name", F.when(F.col("_n") == 1, F.col("_b")).otherwise(suffixed)).drop("_b", "_n")


@dataclass(frozen=True)
class FetchPolicy:
    after: datetime | None = None
    before: datetime | None = None
    most: int | None = 10_000


def fetch_policy(raw: str | int | None, now: datetime | None = None) -> FetchPolicy:
    """'' (default total), N, 'Nd' (days back), 'ddmmyyyy-[ddmmyyyy]' (last day included)."""
    text = str(raw if raw is not None else "").strip().lower()
    now = now or datetime.now(timezone.utc)
    if not text:
        return FetchPolicy()
    if m := re.fullmatch(r"(\d+)d", text):
        return FetchPolicy(after=now - timedelta(days=int(m[1])), most=None)
    if m := re.fullmatch(r"(\d{8})-(\d{8})?", text):
        day = lambda t: datetime.strptime(t, "%d%m%Y").replace(tzinfo=timezone.utc)
        end = day(m[2]) + timedelta(days=1) if m[2] else None
        if end and end <= day(m[1]):
            raise ValueError("the range ends before it begins")
        return FetchPolicy(after=day(m[1]), before=end, most=None)
    if text.isdigit() and int(text) > 0:
        return FetchPolicy(most=int(text))
    raise ValueError(f"cannot read fetch policy: {raw}")


def within(created: Column, policy: FetchPolicy) -> Column:
    out = F.lit(True)
    if policy.after:
        out = out & (created >= F.lit(policy.after))
    if policy.before:
        out = out & (created < F.lit(policy.before))
    return out


def apply_policy(messages: DataFrame, policy: FetchPolicy, created: str = "created_at") -> DataFrame:
    """Messages in the window; the newest ``most`` of each room if there is a total."""
    rows = messages.where(within(F.col(created), policy))
    if policy.most is None:
        return rows
    order = Window.partitionBy("room_id").orderBy(F.desc(created), "message_id")
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= policy.most).drop("_rn")


def messages_url(base: str, room: str, page: int = 500, before: str | None = None) -> str:
    query = {"roomId": room, "max": max(1, min(500, page))} | ({"before": before} if before else {})
    return f"{base}/messages?{urlencode(query)}"


def next_link(header: str | None) -> str | None:
    m = re.search(r'<([^>]+)>\s*;\s*rel="?next"?', header or "")
    return m[1] if m else None


def get_with_retry(get: Callable[[str], tuple[int, dict, object]], url: str, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> tuple[dict, object]:
    """(headers, body) of a GET; 429, 5xx and network errors are tried again after Retry-After or 2^n seconds, 30 at most."""
    for n in range(tries):
        try:
            status, headers, body = get(url)
        except OSError:
            status, headers, body = 599, {}, None
        if status < 400:
            return headers, body
        if status != 429 and status < 500:
            raise RuntimeError(f"{url}: status {status}")
        if n + 1 < tries:
            wait = headers.get("Retry-After", "")
            sleep(min(30.0, float(wait) if str(wait).isdigit() else 2.0**n))
    raise RuntimeError(f"{url}: gave up after {tries} tries")


def fetch_room(get: Callable[[str], tuple[int, dict, object]], base: str, room: str, policy: FetchPolicy, page: int = 500) -> list[dict]:
    """A room's messages under a policy, oldest first. Pages come newest first, so fetching stops at the window's start."""
    url, out = messages_url(base, room, page, policy.before.strftime("%Y-%m-%dT%H:%M:%SZ") if policy.before else None), []
    while url:
        headers, body = get_with_retry(get, url)
        for m in body.get("items", []):
            at = datetime.fromisoformat(m["created"].replace("Z", "+00:00"))
            if policy.before and at >= policy.before:
                continue
            if (policy.after and at < policy.after) or (policy.most is not None and len(out) >= policy.most):
                return sorted(out, key=lambda x: x["created"])
            out.append(m)
        url = next_link(headers.get("Link"))
    return sorted(out, key=lambda x: x["created"])


def fetch_rooms(rooms: DataFrame, get: Callable, base: str, policy: FetchPolicy) -> DataFrame:
    """Messages of all rooms over REST, one task per few rooms."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([_row(room, m) for room in pdf["room_id"] for m in fetch_room(get, base, room, policy)], columns=[c.split()[0] for c in MESSAGE.split(", ")])

    return rooms.select("room_id").repartition("room_id").mapInPandas(run, MESSAGE)
