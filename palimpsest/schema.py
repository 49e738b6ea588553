"""Table schemas (as DDL, so that importing needs no session) and nested run metadata."""

from __future__ import annotations

EPISODE = (
    "uuid string, name string, content string, content_embedding array<float>, source string, "
    "source_description string, kind string, created_at timestamp, valid_at timestamp, "
    "user_id string, agent_id string, metadata string, entity_edges array<string>"
)
ENTITY = (
    "uuid string, name string, entity_type string, summary string, name_embedding array<float>, "
    "mentions bigint, created_at timestamp, user_id string, labels array<string>, "
    "attributes map<string,string>"
)
EDGE = (
    "uuid string, source_uuid string, target_uuid string, name string, fact string, "
    "fact_embedding array<float>, created_at timestamp, valid_at timestamp, invalid_at timestamp, "
    "expired_at timestamp, episodes array<string>, mentions bigint, attributes map<string,string>"
)
MENTION = (
    "uuid string, episode_uuid string, entity_uuid string, created_at timestamp"
)
TRIGGER = (
    "uuid string, source_uuid string, target_uuid string, created_at timestamp"
)
TOOL = (
    "uuid string, tool_name string, description string, name_embedding array<float>, "
    "mentions bigint, created_at timestamp"
)
INSTRUCTION = (
    "uuid string, agent_type string, base_instruction string, enhanced_instruction string, "
    "query_augmentation_template string, memory_enabled boolean, tool_tracking_enabled boolean, "
    "created_at timestamp, updated_at timestamp"
)
CONFIG = (
    "key string, value string, category string, data_type string, is_sensitive boolean, "
    "updated_at timestamp, description string"
)
COMMUNITY = (
    "uuid string, name string, summary string, created_at timestamp, members array<string>, "
    "member_count bigint"
)

GRAPH_TABLES = {
    "episodes": EPISODE, "entities": ENTITY, "edges": EDGE, "mentions": MENTION,
    "triggered": TRIGGER, "tools": TOOL, "instructions": INSTRUCTION, "config": CONFIG,
    "communities": COMMUNITY,
}

TOOL_CALL_DDL = (
    "struct<tool_name:string,success:boolean,duration_ms:bigint,timestamp:string,"
    "input_params:map<string,string>,output_summary:string,error:string,parent_tool_name:string>"
)
RUN_DDL = (
    "struct<run_id:string,user_id:string,timestamp:string,query:string,augmented_query:string,"
    f"agent_response:string,tools_used:array<{TOOL_CALL_DDL}>,llm_saved_memory:string>"
)
MEMORY_DDL = "struct<content:string,user_id:string,session_id:string,source:string>"
METADATA_DDL = (
    f"integration string, tags array<string>, memories array<{MEMORY_DDL}>, "
    f"sessions map<string,array<{RUN_DDL}>>, tools_used array<{TOOL_CALL_DDL}>"
)
METADATA = METADATA_DDL
TAGS_ONLY = "tags array<string>"
# `integration` as a second field makes a malformed document a null struct, not a null map.
SESSION_KEYS = "sessions map<string,string>"

# Enumerations, and the defaults of the search request.
EPISODE_SOURCES = ("message", "json", "text")
EPISODE_KINDS = ("query", "memory")
DEFAULT_INTEGRATION = "google_adk"
