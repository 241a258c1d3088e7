"""Field-mapping configuration: which paths become which columns, what is left out, split, aliased and transformed."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

import yaml

# The paths whose column is not the last part of the path (letters and digits only); for all other paths that
# rule gives the column. Then where channel, event id and time are looked for.
RENAMED = {
    "Event.System.EventID.#text": "EventID", "Event.System.Provider.#attributes.Name": "Provider_Name", "Event.EventData.TargetFilename": "TargetFileName", "Event.EventData.SamAccountName": "SAMAccountName",
    "Event.EventData.Data.#text": "Message", "dns.question.name": "QueryName", "dns.question.registered_domain": "QueryName", "dns.answers.data": "QueryResults", "dns.resolved_ip": "DestinationIp",
    "network.protocol": "Protocol", "file.code_signature.subject_name": "Signature", "file.code_signature.status": "SignatureStatus", "file.code_signature.valid": "Signed", "file.pe.imphash": "Imphash",
    "file.pe.original_file_name": "OriginalFileName", "file.path": "TargetFilename", "file.name": "TargetFileName", "file.directory": "TargetFilename", "process.command_line": "CommandLine",
    "process.executable": "Image", "process.name": "ProcessName", "process.pid": "ProcessId", "process.entity_id": "ProcessGuid", "process.working_directory": "CurrentDirectory", "process.args": "ProcessArgs",
    "process.parent.command_line": "ParentCommandLine", "process.parent.executable": "ParentImage", "process.parent.name": "ParentProcessName", "process.parent.pid": "ParentProcessId",
    "process.parent.entity_id": "ParentProcessGuid", "process.hash.md5": "MD5", "process.hash.sha1": "SHA1", "process.hash.sha256": "SHA256", "process.hash.imphash": "Imphash",
    "hash.md5": "MD5", "hash.sha1": "SHA1", "hash.sha256": "SHA256", "hash.imphash": "Imphash", "user.name": "User", "user.domain": "UserDomain", "user.id": "UserSid", "host.name": "Computer",
    "host.hostname": "ComputerName", "event.code": "EventID", "event.action": "EventType", "event.provider": "Provider_Name", "event.created": "EventTime", "winlog.channel": "Channel",
    "winlog.event_id": "EventID", "winlog.computer_name": "Computer", "winlog.provider_name": "Provider_Name", "winlog.provider_guid": "Guid", "winlog.record_id": "EventRecordID", "winlog.task": "Task",
    "winlog.opcode": "Opcode", "winlog.event_data.TargetFilename": "TargetFileName",
}
CHANNEL_PATHS = ["Event.System.Channel", "Channel", "winlog.channel"]
EVENTID_PATHS = ["Event.System.EventID", "EventID", "winlog.event_id"]
TIME_PATHS = ["SystemTime", "UtcTime", "TimeCreated", "timestamp", "@timestamp", "_time", "Timestamp", "EventTime"]


@dataclass
class Mapping:
    """paths ending in the name of an event field need no entry: the last part of a path, letters and digits only, is its column."""

    fields: dict[str, str] = field(default_factory=lambda: dict(RENAMED))
    exclusions: list[str] = field(default_factory=lambda: ["xmlns"])
    useless: list = field(default_factory=lambda: [None, ""])
    alias: dict[str, list[str]] = field(default_factory=dict)
    split: dict[str, tuple[str, str]] = field(default_factory=lambda: {"Hashes": (",", "="), "Hash": (",", "="), "ConfigurationFileHash": (",", "=")})
    keep_split: list[str] = field(default_factory=lambda: ["Hashes"])
    transforms: list[str] | None = None  # None: all; []: none
    channel_paths: list[str] = field(default_factory=lambda: list(CHANNEL_PATHS))
    eventid_paths: list[str] = field(default_factory=lambda: list(EVENTID_PATHS))
    time_fields: list[str] = field(default_factory=lambda: list(TIME_PATHS))


def load_mapping(path: str) -> Mapping:
    """A YAML or JSON file with mappings, exclusions, useless, alias, split, transforms_enabled and event_filter sections."""
    text = Path(path).read_text()
    d = json.loads(text) if path.endswith(".json") else yaml.safe_load(text)
    m = Mapping()
    m.fields = dict(d.get("mappings") or m.fields)
    m.exclusions = list(d.get("exclusions") or [])
    m.useless = list(d.get("useless") or [])
    m.alias = {k: [v] if isinstance(v, str) else list(v) for k, v in (d.get("alias") or {}).items()}
    m.split = {k: (v["separator"], v["equal"]) for k, v in (d.get("split") or {}).items()}
    if "transforms_enabled" in d or "enabled_transforms" in d:
        enabled = d.get("enabled_transforms")
        m.transforms = [] if d.get("transforms_enabled") is False else list(enabled) if enabled is not None else None
    f = d.get("event_filter") or {}
    m.channel_paths = list(f.get("channel_fields") or m.channel_paths)
    m.eventid_paths = list(f.get("eventid_fields") or m.eventid_paths)
    m.time_fields = list((d.get("timestamp_detection") or {}).get("detection_fields") or m.time_fields)
    return m
