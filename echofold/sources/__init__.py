"""Where candidate regions come from: source trees, git, and tables of documents or pages."""
