"""Tables of a versioned, content-addressed file store."""

from __future__ import annotations

TREE = "path string, file_id long, hash string, size int"
NODE = "node_id string, parent_id string, name string, kind string, file_id long, hash string, size long"
REVISION = "branch long, number long, revision string, parent_self string, parent_other string"
BRANCH = "id long, name string, latest string, creator long, created timestamp, stack array<struct<branch: bigint, revision: string>>"
DEPENDENCY = "source long, target long, tag string"
FRAGMENT_REF = "doc_id long, part string, seq long, hash string, sz int"
CHANGE = "action string, path string, from_path string, file_id long, hash string, from_hash string, size int"
EVENT = "event_id long, ts timestamp, repository long, kind string, branch long, number long, owner long, resource long"
LOCK = "branch long, resource long, owner long, locked_at timestamp"
KV = "repository long, branch long, value long"
FILTER_RULE = "seq int, glob string, negated boolean"
METADATA = "revision string, key string, type string, str string, num long"
