"""Reading sheets and logs, writing reports."""
