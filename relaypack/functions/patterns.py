"""Detectors, labels and marks that decide results."""

from __future__ import annotations

# Detector names and their patterns.
DETECTORS = {
    "api_key": r"\b(?:sk-[A-Za-z0-9_-]{8,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,})\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?<!\w)(?:\+?\d[\d ()-]{7,}\d)(?!\w)",
}
DEFAULT_DETECTORS = ("api_key", "email")
DETECTOR_NAME = r"[A-Za-z0-9_.-]{1,64}"
MAX_CUSTOM = 32

# Structured keys that name a section.
KEY_SECTIONS = {
    "constraint": "constraints", "constraints": "constraints", "requirement": "constraints", "requirements": "constraints",
    "decision": "decisions", "decisions": "decisions", "accepted_decision": "decisions",
    "evidence": "evidence", "source": "evidence", "finding": "evidence", "findings": "evidence",
    "completed": "completed_work", "completed_work": "completed_work", "done": "completed_work",
    "failed_attempt": "failed_attempts", "failed_attempts": "failed_attempts", "rejected_approach": "failed_attempts",
    "pending": "pending_work", "pending_work": "pending_work", "todo": "pending_work", "next": "pending_work", "unresolved": "pending_work",
    "tool_result": "tool_results", "tool_results": "tool_results", "tool_output": "tool_results", "test_result": "tool_results",
}

# Labels that open a section in a text.
TEXT_LABELS = {
    "constraint": "constraints", "constraints": "constraints", "requirement": "constraints", "must": "constraints", "约束": "constraints", "要求": "constraints", "必须": "constraints",
    "decision": "decisions", "decided": "decisions", "accepted decision": "decisions", "决定": "decisions", "已决定": "decisions", "采用": "decisions",
    "evidence": "evidence", "source": "evidence", "finding": "evidence", "证据": "evidence", "依据": "evidence", "发现": "evidence",
    "completed": "completed_work", "completed work": "completed_work", "done": "completed_work", "implemented": "completed_work", "已完成": "completed_work", "完成": "completed_work",
    "failed attempt": "failed_attempts", "tried and failed": "failed_attempts", "rejected approach": "failed_attempts", "失败尝试": "failed_attempts", "已否决": "failed_attempts",
    "pending": "pending_work", "pending work": "pending_work", "todo": "pending_work", "next": "pending_work", "unresolved": "pending_work", "待办": "pending_work", "下一步": "pending_work", "未解决": "pending_work",
    "tool result": "tool_results", "command result": "tool_results", "test result": "tool_results", "工具结果": "tool_results", "命令结果": "tool_results", "测试结果": "tool_results",
}

# Kinds of tool rows, metadata keys that hint at a section, marks in texts.
TOOL_KINDS = ("tool", "tool_result", "tool_results", "tool_output")
HINT_KEYS = ("handoff_section", "receiver_section")
REDACTED = "[REDACTED:{}]"
EXTRACT = "[offline extract] "
STATUS_PREFIX = {"observed": "", "proposed": "[Proposed] ", "uncertain": "[Unverified] "}

#: What splits lines and what is stripped, by Unicode.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
BLANKS = "\\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
