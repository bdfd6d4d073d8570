"""Example workflows and fault scenarios, as files would hold them."""

from __future__ import annotations

# Fixed values -------------------------------------------------------------------------------------------------------

WORKFLOWS = {
    "data-pipeline": """{name: data-pipeline, version: 1, steps: [
 {name: import, handler: import_csv, retry: {max_attempts: 3, initial_delay: 1s, multiplier: 2, max_delay: 30s, jitter: 0.2}},
 {name: validate, handler: validate_rows, depends_on: [import]}, {name: analyze, handler: analyze, depends_on: [validate]}, {name: report, handler: generate_report, depends_on: [analyze]}]}""",
    "effectful": """{name: effectful, version: 1, steps: [{name: import, handler: import_csv},
 {name: charge, handler: charge_once, depends_on: [import], retry: {max_attempts: 3, initial_delay: 100ms, multiplier: 2, max_delay: 1s, jitter: 0}}, {name: report, handler: summarize, depends_on: [charge]}]}""",
    "fan-out": """{name: fan-out, version: 1, steps: [{name: split, handler: split_input}, {name: shard_a, handler: process_shard, depends_on: [split]},
 {name: shard_b, handler: process_shard, depends_on: [split]}, {name: shard_c, handler: process_shard, depends_on: [split]}, {name: merge, handler: merge_shards, depends_on: [shard_a, shard_b, shard_c]}]}""",
    "idempotent-effect": """{name: idempotent-effect, version: 1, steps: [
 {name: charge, handler: effect_then_die, retry: {max_attempts: 3, initial_delay: 100ms, multiplier: 2, max_delay: 1s, jitter: 0}}, {name: confirm, handler: summarize, depends_on: [charge]}]}""",
    "slow-pipeline": """{name: slow-pipeline, version: 1, steps: [{name: import, handler: import_csv},
 {name: crunch, handler: slow_step, depends_on: [import], retry: {max_attempts: 3, initial_delay: 100ms, multiplier: 2, max_delay: 2s, jitter: 0.1}}, {name: report, handler: summarize, depends_on: [crunch]}]}""",
}
SCENARIOS = {
    "db-disconnect-on-import": """{name: db-disconnect-on-import, seed: 8675309, faults: [{type: db-disconnect, target: {task: import, attempt: 1}, at: after-task-start}],
 assert: {run_status: SUCCEEDED, lost_tasks: 0, duplicate_effects: 0, min_retries_per_task: 1, faults_injected: 1}}""",
    "duplicate-delivery-on-charge": """{name: duplicate-delivery-on-charge, seed: 31337, workflow: effectful, faults: [{type: duplicate-delivery, target: {task: charge, attempt: 1}, at: after-task-finish}],
 assert: {run_status: SUCCEEDED, lost_tasks: 0, duplicate_effects: 0, max_retries_per_task: 0, faults_injected: 1}}""",
    "upstream-503-on-validate": """{name: upstream-503-on-validate, seed: 2024, faults: [{type: http-error, target: {task: validate, attempt: 1}, at: after-task-start, params: {status: 503}}],
 assert: {run_status: SUCCEEDED, lost_tasks: 0, duplicate_effects: 0, min_retries_per_task: 1, max_retries_per_task: 1, faults_injected: 1}}""",
    "latency-during-analyze": """{name: latency-during-analyze, seed: 1337, faults: [{type: latency, target: {task: analyze}, at: after-task-start, params: {duration: 2s}}],
 assert: {run_status: SUCCEEDED, lost_tasks: 0, duplicate_effects: 0, max_retries_per_task: 0, faults_injected: 1}}""",
    "baseline-no-faults": """{name: baseline-no-faults, seed: 1, faults: [], assert: {run_status: SUCCEEDED, lost_tasks: 0, duplicate_effects: 0, max_retries_per_task: 0, faults_injected: 0}}""",
    "upstream-down-throughout": """{name: upstream-down-throughout, seed: 7, faults: [{type: http-error, target: {task: validate}, at: after-task-start, params: {status: 503}}],
 assert: {run_status: FAILED, max_retries_per_task: 2, duplicate_effects: 0}}""",
    "worker-crash-after-effect": """{name: worker-crash-after-effect, workflow: effectful, seed: 1337, faults: [{type: worker-crash, target: {task: charge, attempt: 1}, at: before-task-ack}],
 assert: {run_status: SUCCEEDED, lost_tasks: 0, duplicate_effects: 0, max_recovery_time_ms: 8000, max_retries_per_task: 2}}""",
    "worker-crash-during-analyze": """{name: worker-crash-during-analyze, seed: 42, faults: [{type: worker-crash, target: {task: analyze, attempt: 1}, at: after-task-start}],
 assert: {run_status: SUCCEEDED, lost_tasks: 0, duplicate_effects: 0, max_recovery_time_ms: 5000, max_retries_per_task: 2}}""",
}
