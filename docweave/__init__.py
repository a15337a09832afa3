"""docweave: a PySpark-native engine for querying, reshaping and editing JSON documents held in DataFrame columns."""
