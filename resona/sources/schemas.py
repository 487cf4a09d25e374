"""Schemas of the raw inputs. Counters and epochs are text: coercion is part of the job."""

from __future__ import annotations

_USER = "STRUCT<id: STRING, unique_id: STRING, nickname: STRING, region: STRING>"
_COUNTS = (
    "create_time STRING, duration STRING, play_count STRING, digg_count STRING, "
    "comment_count STRING, share_count STRING, collect_count STRING"
)
_RECORD_COUNTS = _COUNTS.replace(" STRING", ": STRING")

POSTS_RAW = f"""
video_id STRING, title STRING, region STRING, download_count STRING, {_COUNTS},
author STRUCT<id: STRING, unique_id: STRING, nickname: STRING>,
music_info STRUCT<id: STRING, title: STRING>,
commerce_info STRUCT<adv_promotable: BOOLEAN>,
images ARRAY<STRING>,
comments ARRAY<STRUCT<id: STRING, text: STRING, create_time: STRING, digg_count: STRING, user: {_USER}>>
"""

AUTHORS_RAW = """
author_id STRING,
user STRUCT<uniqueId: STRING, nickname: STRING>,
stats STRUCT<followingCount: BIGINT, followerCount: BIGINT, heartCount: BIGINT, videoCount: BIGINT, diggCount: BIGINT>
"""

AUTHOR_ACTIVITY_RAW = f"author_id STRING, record ARRAY<STRUCT<id: STRING, {_RECORD_COUNTS}>>"

NETWORK_RAW = f"author_id STRING, record ARRAY<{_USER}>"

SUMMARIES = """
video_id STRING, content_type STRING, summary_text STRING, n_image_files BIGINT,
has_local_video BOOLEAN, has_local_audio BOOLEAN
"""

RAW_TABLES = {
    "posts": POSTS_RAW,
    "authors": AUTHORS_RAW,
    "author_posts": AUTHOR_ACTIVITY_RAW,
    "author_favorites": AUTHOR_ACTIVITY_RAW,
    "author_followers": NETWORK_RAW,
    "author_followings": NETWORK_RAW,
}
