"""Readers and writers: corpus tables, conversation exports, Markdown, JSONL, exports."""
