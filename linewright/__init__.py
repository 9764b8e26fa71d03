"""Log triage on Spark: parse, normalize, template, label, group and score log lines.

Every operator is a plain Column or DataFrame function; nothing here runs Python code
on executors.
"""

__version__ = "0.1.0"
