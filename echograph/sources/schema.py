"""Explicit schemas of the archive's files; nothing is inferred at read time."""

from __future__ import annotations

MESSAGE = """
id long, date timestamp, edit_date timestamp, channel_id long, message string, views long, forwards long,
replies_count long, has_media boolean, media_type string, grouped_id long, post_author string, pinned boolean,
noforwards boolean, post boolean, reactions_json map<string,bigint>,
entities_json array<struct<type:string,offset:int,length:int,url:string,user_id:bigint,language:string>>,
fwd_from struct<source_channel_id:bigint,source_msg_id:bigint,source_date:timestamp,source_author:string>
"""

REGISTRY = """
channel_id long, handles array<string>, title string, discoveries array<struct<tag:string,step:int>>,
first_seen_tag string, first_seen_step int, last_scraped_step int, last_scraped_tag string, last_scraped_at timestamp
"""

ERRORS = """
handle string, first_seen_step int, first_seen_tag string, seen_in_tags array<string>, attempt_count int,
last_attempt_at timestamp, last_error string
"""

QUEUE = """
handle string, origin_channels array<string>, discovered_via array<string>, is_seed boolean, status string,
error string, note string, duration_s double
"""

NODES = """
handle string, tag string, depth int, seed boolean, type string, language string, language_default_policy string,
lang_confidence double, n_msgs long, n_posts long, n_text_msgs long, n_forward_msgs long, median_views long,
subscribers long, modal_hour_utc int
"""

PAIRS = """
a_handle string, a_msg_id long, a_date timestamp, b_handle string, b_msg_id long, b_date timestamp, sim double,
a_n_channels long, b_n_channels long
"""
