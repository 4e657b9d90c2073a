"""veracity.llm"""
