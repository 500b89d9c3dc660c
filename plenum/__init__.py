"""plenum: civic-meeting analytics as PySpark DataFrame operators."""
