"""Sources and sinks of typed values: text and binary forms, record files in XML, dictionaries."""
