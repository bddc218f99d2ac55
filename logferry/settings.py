"""Fixed values of the log data model, and the parameters of one run."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# --- Fixed values -----------------------------------------------------------------------------
# These must stay as they are for results to agree with existing deployments.

# Severity order of structured records, most severe last.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")
DEFAULT_MIN_LEVEL = "INFO"

# A line that starts a record: a date, optionally in brackets, or a JSON object.
RECORD_START = r"^[\[(]?\d{4}-\d\d-\d\d|^\{"
# First character that is not whitespace; no-break spaces do not count as whitespace.
NON_BLANK_START = r"^(?:[^\p{Z}\t-\r\x1c-\x1f]|[\x{00a0}\x{2007}\x{202f}])"
# The token of a text record that may hold its timestamp.
TIMESTAMP_TOKEN = r"([\w\-:.+]+)"
# File name pattern of a component without its own; %s is the quoted file stem.
DEFAULT_FILE_REGEX = r"^%s\w*.log"

STREAM_TEMPLATE = "/{date}/thing/{device}"

FINGERPRINT_BYTES = 1024
EVENT_OVERHEAD = 26 + 8
MAX_BATCH_BYTES = 1024 * 1024
MAX_EVENT_BYTES = 256 * 1024 - EVENT_OVERHEAD
MAX_BATCH_EVENTS = 10_000
MAX_BATCH_SPAN = dt.timedelta(hours=23)
MAX_EVENT_AGE = dt.timedelta(days=14)
IDLE_LIMIT = dt.timedelta(hours=24)
MAX_TRIES = 3
DEFAULT_INTERVAL_SEC = 300.0
SIZE_UNITS = {"KB": 1024, "MB": 1024**2, "GB": 1024**3}

# Keys of the rule documents.
RULE_MAP_KEY = "componentLogsConfigurationMap"
RULE_LIST_KEY = "componentLogsConfiguration"
SYSTEM_RULE_KEY = "systemLogsConfiguration"
# ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Parameters of one collection cycle; every clock is explicit, so a run can be repeated."""

    as_of: dt.datetime
    device: str = "device"
    region: str = "local"
    group_template: str = "/logs/{type}/{region}/{component}"
    max_event_bytes: int = MAX_EVENT_BYTES
    max_batch_bytes: int = MAX_BATCH_BYTES
    max_batch_events: int = MAX_BATCH_EVENTS
    max_batch_span: dt.timedelta = MAX_BATCH_SPAN
    max_event_age: dt.timedelta = MAX_EVENT_AGE
    idle_limit: dt.timedelta = IDLE_LIMIT
    joiner: str = ""
    # Bytes of log text one task handles as a unit; ranges are cut at line starts.
    range_bytes: int = 8 * 1024 * 1024
    # Bytes of log text one reading task goes through, range after range.
    task_bytes: int = 256 * 1024 * 1024
    # Longer records aren't parsed as JSON, and their time is looked for in their first bytes only.
    whole_bytes: int = 64 * 1024 * 1024
    head_bytes: int = 64 * 1024
    # Events one packing task handles as a unit.
    pack_block: int = 1 << 19
    hold_last_line: bool = True
    hold_last_record: bool = False

    @property
    def as_of_ms(self) -> int:
        moment = self.as_of if self.as_of.tzinfo else self.as_of.replace(tzinfo=dt.timezone.utc)
        return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1)
