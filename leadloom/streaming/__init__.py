"""leadloom.streaming"""
