"""tieout: statement auditing as set-based Spark DataFrame operators."""
