"""The ranking model's operators."""
