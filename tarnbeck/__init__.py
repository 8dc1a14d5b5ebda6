"""A PySpark-native engine for curating, auditing and evaluating collections of tasks, texts and conversations."""
