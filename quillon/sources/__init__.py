"""Readers and writers of task files, logs, training sets and dumps."""
