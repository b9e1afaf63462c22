"""Column expressions; nothing here touches a table."""
