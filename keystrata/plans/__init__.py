"""Named query plans with their SQL, sessions and run reports."""
