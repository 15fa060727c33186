"""Explicit schemas of the record types; readers never infer."""

from __future__ import annotations

# Names of the domains and keys of the file formats.
DOMAINS = ("airline", "retail", "telecom")
TOOL_CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,tool_call_id:string,tool_calls:array<{TOOL_CALL}>,raw_data:struct<reasoning_content:string,thinking:string>>"
ACTION_CHECK = "struct<action:struct<name:string,arguments:string>,score:double,found:boolean,reason:string>"
REWARD_INFO = f"struct<reward:double,action_checks:array<{ACTION_CHECK}>,nl_assertions:array<struct<assertion:string,score:double>>,action_reward_info:struct<action_checks:array<{ACTION_CHECK}>>>"
SIMULATION = f"struct<task_id:string,reward:double,termination_reason:string,reward_info:{REWARD_INFO},messages:array<{MESSAGE}>>"
ACTION = "struct<action_id:string,name:string,arguments:string,compare_args:array<string>,requestor:string,sequence_order:int>"
CRITERIA = f"struct<actions:array<{ACTION}>,communicate_info:array<string>,nl_assertions:array<string>,reward_basis:array<string>>"
SCENARIO = "struct<persona:string,instructions:struct<domain:string,reason_for_call:string,known_info:string,task_instructions:string,unknown_info:string>>"
TASK = f"id string, description struct<purpose:string,relevant_policies:string,notes:string>, user_scenario {SCENARIO}, initial_state string, evaluation_criteria {CRITERIA}, annotations string"
EVAL_TASK = f"struct<id:string,user_scenario:{SCENARIO},evaluation_criteria:{CRITERIA},expected_turns:int>"
EVAL_FILE = f"info struct<agent_info:struct<llm:string,llm_args:string>>, tasks array<{EVAL_TASK}>, simulations array<{SIMULATION}>"
SFT = "messages array<struct<role:string,content:string>>, tools string, metadata struct<source:string,domain:string,task_id:string,attempt:int,reward:double,termination:string>"
LEGACY = "system string, tools string, conversations array<struct<from:string,value:string>>"
TOOL_FILE = "type string, function struct<name:string,description:string,parameters:struct<properties:map<string,string>,required:array<string>>>"
ERROR_DB = "domain string, tool string, error string, count long, examples array<string>"
CHECKPOINT = "domain string, task_id string, trial int"
# End of fixed values.
