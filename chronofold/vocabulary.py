"""The journal's vocabulary: event types, statuses, legal transitions, groups, labels, table schemas and defaults."""

from __future__ import annotations

# Fixed values -----------------------------------------------------------------------------------------------------

EVENT_TYPES = (
    "RUN_CREATED", "RUN_QUEUED", "RUN_STARTED", "RUN_SUCCEEDED", "RUN_FAILED", "RUN_CANCELLED",
    "TASK_SCHEDULED", "TASK_LEASED", "TASK_STARTED", "TASK_SUCCEEDED", "TASK_FAILED", "TASK_RETRY_SCHEDULED",
    "TASK_LEASE_EXPIRED", "TASK_REQUEUED", "TASK_DEAD_LETTERED",
    "WORKER_REGISTERED", "WORKER_HEARTBEAT", "WORKER_SUSPECT", "WORKER_LOST",
    "FAULT_INJECTED", "SIDE_EFFECT_SKIPPED",
)
TERMINAL_TYPES = ("RUN_SUCCEEDED", "RUN_FAILED", "RUN_CANCELLED")
TROUBLE_TYPES = ("TASK_LEASE_EXPIRED", "FAULT_INJECTED", "TASK_FAILED", "WORKER_LOST")
STORY_TYPES = (
    "FAULT_INJECTED", "WORKER_LOST", "TASK_LEASE_EXPIRED", "TASK_REQUEUED", "TASK_RETRY_SCHEDULED",
    "TASK_STARTED", "SIDE_EFFECT_SKIPPED", "TASK_SUCCEEDED", "TASK_DEAD_LETTERED",
)

#: The status that an event type gives its run or task; types that leave it alone are absent.
RUN_STATUS_OF = {
    "RUN_CREATED": "CREATED", "RUN_QUEUED": "QUEUED", "RUN_STARTED": "RUNNING",
    "RUN_SUCCEEDED": "SUCCEEDED", "RUN_FAILED": "FAILED", "RUN_CANCELLED": "CANCELLED",
}
TASK_STATUS_OF = {
    "TASK_SCHEDULED": "READY", "TASK_LEASED": "LEASED", "TASK_STARTED": "RUNNING", "TASK_SUCCEEDED": "SUCCEEDED",
    "TASK_FAILED": "FAILED", "TASK_RETRY_SCHEDULED": "RETRYING", "TASK_REQUEUED": "READY", "TASK_DEAD_LETTERED": "DEAD",
}

RUN_STATUSES = ("CREATED", "QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")
TASK_STATUSES = ("PENDING", "READY", "LEASED", "RUNNING", "SUCCEEDED", "FAILED", "RETRYING", "DEAD")
WORKER_STATUSES = ("HEALTHY", "SUSPECT", "LOST", "STOPPED")
RUN_TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED")
TASK_TERMINAL = ("SUCCEEDED", "DEAD")
TASK_HOLDS = ("LEASED", "RUNNING")

RUN_TRANSITIONS = {
    "CREATED": ("QUEUED", "CANCELLED"),
    "QUEUED": ("RUNNING", "SUCCEEDED", "FAILED", "CANCELLED"),
    "RUNNING": ("SUCCEEDED", "FAILED", "CANCELLED"),
    "SUCCEEDED": (), "FAILED": (), "CANCELLED": (),
}
TASK_TRANSITIONS = {
    "PENDING": ("READY", "FAILED", "DEAD"),
    "READY": ("LEASED", "DEAD"),
    "LEASED": ("RUNNING", "READY", "FAILED", "DEAD"),
    "RUNNING": ("SUCCEEDED", "FAILED", "READY", "DEAD"),
    "FAILED": ("RETRYING", "DEAD"),
    "RETRYING": ("READY", "DEAD"),
    "SUCCEEDED": (), "DEAD": (),
}

GROUPS_OF = {
    "RUN_CREATED": ("run",), "RUN_QUEUED": ("run",), "RUN_STARTED": ("run",), "RUN_SUCCEEDED": ("run",),
    "RUN_FAILED": ("run", "error"), "RUN_CANCELLED": ("run", "error"),
    "TASK_SCHEDULED": ("task",), "TASK_LEASED": ("task",), "TASK_STARTED": ("task",), "TASK_SUCCEEDED": ("task",),
    "TASK_FAILED": ("task", "error"), "TASK_DEAD_LETTERED": ("task", "error", "recovery"),
    "TASK_LEASE_EXPIRED": ("task", "recovery", "worker"),
    "TASK_REQUEUED": ("task", "recovery"), "TASK_RETRY_SCHEDULED": ("task", "recovery"),
    "WORKER_REGISTERED": ("worker",), "WORKER_HEARTBEAT": ("worker",),
    "WORKER_SUSPECT": ("worker", "recovery"), "WORKER_LOST": ("worker", "recovery", "error"),
    "FAULT_INJECTED": ("fault",), "SIDE_EFFECT_SKIPPED": ("effect", "recovery"),
}
LABEL_OF = {
    "RUN_CREATED": "Run created", "RUN_QUEUED": "Run queued", "RUN_STARTED": "Run started",
    "RUN_SUCCEEDED": "Workflow completed", "RUN_FAILED": "Workflow failed", "RUN_CANCELLED": "Workflow cancelled",
    "TASK_SCHEDULED": "Task ready to run", "TASK_LEASED": "Task claimed by a worker", "TASK_STARTED": "Task running",
    "TASK_SUCCEEDED": "Task finished", "TASK_FAILED": "Task failed", "TASK_RETRY_SCHEDULED": "Retry scheduled",
    "TASK_LEASE_EXPIRED": "Worker stopped responding", "TASK_REQUEUED": "Task returned to the queue",
    "TASK_DEAD_LETTERED": "Task gave up", "WORKER_REGISTERED": "Worker joined", "WORKER_HEARTBEAT": "Worker heartbeat",
    "WORKER_SUSPECT": "Worker doubted", "WORKER_LOST": "Worker declared gone",
    "FAULT_INJECTED": "Failure injected on purpose", "SIDE_EFFECT_SKIPPED": "Duplicate effect prevented",
}
STATUS_MEANING = {
    "SUCCEEDED": "finished, with every task done", "FAILED": "stopped because a task ran out of attempts",
    "CANCELLED": "stopped on purpose", "RUNNING": "in progress", "QUEUED": "waiting for a worker",
    "CREATED": "accepted, not yet queued", "PENDING": "waiting on a dependency", "READY": "claimable now",
    "LEASED": "held by a worker", "RETRYING": "failed, waiting for its next attempt", "DEAD": "out of attempts",
    "HEALTHY": "heartbeating", "SUSPECT": "missed beats, work not yet reclaimed", "LOST": "gone, leases released",
    "STOPPED": "shut down and said so",
}

FAULT_TYPES = ("worker-crash", "duplicate-delivery", "latency", "http-error", "db-disconnect")
FAULT_TYPES_PLANNED = ("queue-overload",)
FAULT_POINTS = ("before-claim", "after-task-lease", "after-task-start", "before-task-ack", "after-task-finish")

#: Payload keys in the order of the one-line summary, on the command line and in the dashboard.
SUMMARY_KEYS = (
    "attempt", "error", "reason", "detail", "delay_ms", "duration_ms", "next_attempt", "fault_type",
    "idempotency_key", "task_count", "tasks_succeeded", "leases_released", "missed_beats",
)
SUMMARY_KEYS_WEB = (
    "attempt", "next_attempt", "error", "reason", "detail", "delay_ms", "duration_ms", "fault_type",
    "idempotency_key", "task_count", "tasks_succeeded", "leases_released", "missed_beats",
)

BENCH_COLUMNS = (
    "workers", "runs", "fault_rate", "workflow", "runs_completed", "runs_succeeded", "runs_failed", "wall_clock_s",
    "runs_per_second", "tasks_executed", "tasks_per_second", "retries", "lost_tasks", "run_p50_ms", "run_p95_ms",
    "run_p99_ms", "run_max_ms", "recovery_p50_ms", "recovery_p95_ms", "recovery_max_ms",
)

#: Lease, renewal and heartbeat periods and the reaper's, in milliseconds; beats to suspicion and loss.
LEASE_MS, RENEW_MS, BEAT_MS, REAPER_MS, TIMEOUT_MS = 30_000, 10_000, 5_000, 1_000, 300_000
SUSPECT_AFTER, LOST_AFTER = 3, 5
MAX_PAGE, DEFAULT_RUNS, DEFAULT_PAGE = 500, 50, 100
DEFAULT_RETRY = {"max_attempts": 3, "initial_delay_ms": 1_000, "multiplier": 2.0, "max_delay_ms": 30_000, "jitter": 0.2}

# End of fixed values ----------------------------------------------------------------------------------------------

JOURNAL = "run_id long, seq long, type string, task_name string, worker_id string, payload string, occurred_at timestamp_ntz"
PAYLOAD = (
    "v int, workflow_name string, workflow_version int, definition_hash string, scenario_name string, seed long, "
    "attempt int, next_attempt int, handler string, duration_ms long, error string, retryable boolean, delay_ms long, "
    "reason string, detail string, attempts int, fault_type string, fault_point string, draw long, idempotency_key string, "
    "first_attempt int, missed_beats int, leases_released int, task_count int, tasks_succeeded int, "
    "artifacts array<struct<name:string,sha256:string,size:long,content_type:string>>"
)
TABLES = {
    "workflows": "id string, name string, version int, definition_yaml string, definition_hash string, created_at timestamp_ntz",
    "runs": "id string, workflow_id string, status string, scenario_name string, seed long, event_seq long, correlation_id string, failure_reason string, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz",
    "workers": "id string, hostname string, version string, status string, capacity int, active_tasks int, last_heartbeat timestamp_ntz, registered_at timestamp_ntz",
    "tasks": "id string, run_id string, task_name string, attempt int, max_attempts int, status string, worker_id string, lease_expires_at timestamp_ntz, scheduled_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, input_ref string, output_ref string, error string, idempotency_key string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "task_attempts": "task_id string, attempt int, worker_id string, started_at timestamp_ntz",
    "events": "run_id string, seq long, type string, task_name string, worker_id string, payload string, occurred_at timestamp_ntz",
    "side_effects": "idempotency_key string, run_id string, task_name string, result string, created_at timestamp_ntz",
    "artifacts": "id string, run_id string, task_name string, name string, sha256 string, size long, content_type string, created_at timestamp_ntz",
    "dead_letters": "task_id string, run_id string, reason string, attempts int, last_worker string, created_at timestamp_ntz",
    "schema_migrations": "version int, name string, checksum string, applied_at timestamp_ntz",
}


def sql_list(values) -> str:
    """Values as an SQL list of strings."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
