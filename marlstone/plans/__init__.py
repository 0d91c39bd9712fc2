"""From a question to a governed DataFrame: intents, SQL, plain English, policies, caches and the audit log."""
