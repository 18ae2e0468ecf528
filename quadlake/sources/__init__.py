"""Where statements come from: text files, stored quads, mapped tables; and where results go."""
