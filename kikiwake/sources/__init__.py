"""Sources: articles from files and saved API payloads, logs, dictionaries, paired lines."""
