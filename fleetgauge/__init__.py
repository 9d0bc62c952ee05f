"""Report operators over warehouse telemetry, as lazy PySpark DataFrame functions."""
